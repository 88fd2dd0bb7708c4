"""Document rows with every awkward case, and the brute-force word split."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, taken string, fp string, size string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    """Reproducible words: a linear congruence picks syllables."""
    out, x = [], seed * 2_654_435_761 % 2**32
    for _ in range(n):
        x = (x * 1_664_525 + 1_013_904_223) % 2**32
        out.append(("ka", "lo", "min", "tre", "sau", "vel", "dor", "pin")[x >> 29] + ("ra", "ti", "sen", "mo")[(x >> 20) & 3] + str((x >> 12) & 31))
    return " ".join(out)


def documents(spark, extra=()):
    """Nulls in any column, empty and long texts, repeated rows, ties, clashing extra columns."""
    texts = [
        prose(1, 300), prose(1, 300), prose(2, 120) + "\n" + prose(3, 60), "", None, "one", "one two", " \t\n", "Ümläut 中文 \x1f é",
        prose(4, 30_000), prose(5, 200).replace(" ", " "), "a " * 500, "\n".join([prose(6, 8)] * 30), *extra,
    ]
    rows = [(i, t, "en", f"src{i % 4}", len(t or ""), "x", None, "y") for i, t in enumerate(texts)]
    rows += [(None, prose(7, 80), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[0], rows[2], (2, prose(8, 40), None, "src1", 1, "q", "q", "q")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
