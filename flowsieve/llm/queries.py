"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import additive, centroids, conversations, jaccard_join, mixing, packing, repeats, repetition, secrets, simhash, sketches, token_files, toxicity
from flowsieve.llm.common import held_out
from flowsieve.llm.tokens import Vocabulary
from flowsieve.session import scratch_path

# Vocabulary, what separates its units, and the id that ends a document.
TOKEN_FILES = ("word_bpe_49k.json", "spaced_words", 1)
PACKING = ("byte_bpe_50k.json", "byte_level", 0)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(docs: DataFrame, score: Column, limit: float) -> DataFrame:
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def vocabulary(spark: SparkSession, name: str, boundary: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path(name), boundary)


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = additive.learn(docs, _labels(spark, sf_dir))
    return _scored(docs, additive.score(F.col("text"), model), additive.GOOD_AT)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, boundary, end_id = TOKEN_FILES
    manifest = token_files.write_token_files(
        _documents(spark, sf_dir), scratch_path(spark, "token-files"), vocabulary(spark, name, boundary), end_id=end_id
    )
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, boundary, end_id = PACKING
    return packing.pack(_documents(spark, sf_dir), vocabulary(spark, name, boundary), end_id=end_id).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_documents(spark, sf_dir))
    count = {kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint") for kind in secrets.KINDS[:3]}
    return found.select(
        "doc_id",
        *[n.alias(f"n_{kind}") for kind, n in count.items()],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return sketches.fingerprints(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.as_text(own).alias("fingerprint"),
        sketches.as_text(edited).alias("edited_fingerprint"),
        sketches.resemblance(own, edited).alias("near_edited"),
        sketches.resemblance(own, following).alias("near_next"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.with_rules(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return repeats.remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    lexicon = toxicity.learn(docs, _labels(spark, sf_dir))
    return _scored(docs, toxicity.score(F.col("text"), lexicon), toxicity.TOXIC_AT)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repaired(conversations.damage(rows), rows)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_quality_scores": op2_quality_scores,
    "op3_token_files": op3_token_files,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_packing": op5_packing,
    "op6_secret_spans": op6_secret_spans,
    "op7_bottom_k": op7_bottom_k,
    "op8_quality_rules": op8_quality_rules,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_jaccard_join": op13_jaccard_join,
}


def _rules_sql() -> str:
    """The repetition rules in SQL: words and lines as rows, n-grams as joined text."""
    limits = repetition.COVERAGE_LIMITS
    gram = "string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"
    grams = ", ".join(f"CASE WHEN i + {n - 1} <= n THEN {gram.format(n - 1)} END AS g{n}" for n in (repetition.BASE_LENGTH, *limits))
    again = ", ".join(
        f"coalesce(g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1, false) AS a{n}" for n in limits
    )
    covered = "coalesce(bool_or({}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {} PRECEDING AND CURRENT ROW), false) AS {}"
    covers = ", ".join(covered.format(f"a{n}", n - 1, f"c{n}") for n in limits)
    shares = ", ".join(f"sum(CASE WHEN c{n} THEN length(w) ELSE 0 END) AS s{n}" for n in limits)
    over = " OR ".join(f"coalesce(s{n}, 0) / nullif(chars, 0) > {limit}" for n, limit in limits.items())
    failed = f"(n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT doc_id, i, w, {grams} FROM w),
a AS (SELECT *, coalesce(g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1, false) AS r, {again} FROM g),
c AS (SELECT doc_id, w, {covered.format("r", 2, "cr")}, {covers} FROM a),
x AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS chars, count(*) FILTER (cr) AS n_repeat_words, {shares} FROM c GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d),
l1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) > 1 AS again FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT doc_id, count(*) FILTER (again) AS dup, sum(CASE WHEN again THEN length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) ELSE 0 END) AS dup_chars
  FROM l1 GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce({over} OR dup_chars / nullif(chars, 0) > {repetition.LINE_LIMIT}, false) AS over_limit
  FROM d LEFT JOIN x USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT over_limit AS kept FROM m"""


def _clusters_sql() -> str:
    """Every distance of every round, written out round by round."""
    size = centroids.DIMENSIONS
    squares = f"list_sum([(v[i] - p[i]) * (v[i] - p[i]) for i in range(1, {size + 1})])"

    def nearest(r: int) -> str:
        return (
            f"a{r} AS MATERIALIZED (SELECT row_id, arg_min(c, d * 1000 + c) AS c, min(d) AS d "
            f"FROM (SELECT row_id, c, {squares}::HUGEINT AS d FROM v, p{r}) GROUP BY row_id)"
        )

    def mean(r: int) -> str:
        return (
            f"p{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(m.p, p.p) AS p FROM p{r} p LEFT JOIN ("
            "SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM ("
            f"SELECT c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (row_id), range(1, {size + 1}) t(i) GROUP BY c, i) GROUP BY c) m USING (c))"
        )

    rounds = ", ".join(f"{nearest(r)}, {mean(r)}" for r in range(centroids.ROUNDS))
    last = centroids.ROUNDS
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, [floor({centroids.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {size}),
p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS c, v AS p FROM v
  ORDER BY sha256('{centroids.SEED}:' || vec_id), v LIMIT {centroids.CENTROIDS}),
{rounds}, {nearest(last)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (row_id) JOIN p{last} USING (c)"""


def _repair_sql() -> str:
    """The search as a recursion over rows; a state is its cost, letters and result, the least of which survives."""

    def edited(state: str, cost: str, letter: str, line: str | None) -> str:
        out = f"{state}.o || chr(10) || {line}" if line else f"{state}.o"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}}"

    def least(*states: str) -> str:
        return f"list_min([{', '.join(states)}])"

    none = "{'c': 1000000000000, 'a': '', 'o': ''}"
    inserted_u = [edited(s, "3", "I", "'user:'") for s in ("n", "s", "a")]
    kept = "role || ':' || txt"

    def kept_if(initial: str, state: str) -> str:
        return f"CASE WHEN usable AND left(role, 1) = '{initial}' THEN {edited(state, 'extra', 'K', kept)} ELSE {none} END"

    def recast(state: str, role: str) -> str:
        line = f"'{role}:' || txt"
        return f"CASE WHEN usable THEN {edited(state, '3 + extra', 'R', line)} ELSE {none} END"

    deleted = {s: edited(s, "4", "D", None) for s in "nsua"}
    to_user = [x for s in "nsa" for x in (kept_if("u", s), recast(s, "user"))]
    return f"""WITH RECURSIVE t AS (SELECT list(crc ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS crc FROM range(256) g(n))),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT FOR x IN string_split(key, '')]),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
r0 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS txt,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(txt, '[\x20\x09-\x0D]+$', '') AS said FROM r0),
r AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r1),
f AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS usable, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM r),
d AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS n, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {deleted['n']}, {least(deleted['s'], kept_if('s', 'n'))}, {least(deleted['u'], *to_user)},
    {least(deleted['a'], kept_if('a', 'u'), recast('u', 'assistant'))}
  FROM (SELECT conv_id, i, n, s, u, {least('a', edited('u', '3', 'I', "'assistant:'"))} AS a, role, txt, usable, extra
    FROM (SELECT d.conv_id, f.i, n, s, {least('u', *inserted_u)} AS u, a, role, txt, usable, extra
      FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = d.i + 1))),
l AS (SELECT conv_id, {least('n', 'a', edited('u', '3', 'I', "'assistant:'"))} AS z
  FROM (SELECT conv_id, n, a, {least('u', *inserted_u)} AS u FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, z.c AS cost, z.a AS audit, sha256(z.o[2:]) AS repaired_sha256
FROM l LEFT JOIN c ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


# Every shingle of every set is joined, then reachability spelled out.
_JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END)) AS shingles FROM w),
d AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS id, shingles FROM g),
s AS MATERIALIZED (SELECT id, any_value(n) AS n, any_value(shingles) AS shingles, min(doc_id) AS lowest FROM d WHERE n > 0 GROUP BY id),
e AS MATERIALIZED (SELECT id, n, unnest(shingles) AS x FROM s),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
    WHERE 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
p AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS reached FROM s UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reached),
c AS (SELECT r.id, min(s.lowest) AS component_id FROM r JOIN s ON s.id = r.reached GROUP BY r.id)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN c USING (id)"""


# The other operators rest on hashes, tokenizers, compressors or fitted models and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": _rules_sql(),
    "op11_centroid_clusters": _clusters_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op13_jaccard_join": _JACCARD_SQL,
}
