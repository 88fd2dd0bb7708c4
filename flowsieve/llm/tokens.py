"""Token ids of whole texts with a published tokenizer, memoised by unit.

A unit is a stretch of text no token can cross.  The tokenizer runs once per unit it has
not met lately; invented or natural words repeat so often that this saves most of its time.
Boundaries by kind of vocabulary:

* ``None``: the whole text is one unit;
* ``byte_level``: a single space between two characters that are not white space starts one,
  as the pre-tokenizing pattern attaches that space to what follows;
* ``spaced_words``: spaces and line feeds separate units and carry no ids themselves, and case does not
  matter, as the tokenizer lowers it.

A text that may hold a special token's string is encoded as a whole, since such a token goes before all units.
Texts are cut, and their units told apart and looked up, by Arrow over a batch of texts at a time; only units
that are new become Python strings.  The ids of all units are then gathered by number.

The vocabulary file is read by the driver and broadcast; its size is that of one vocabulary.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already

# Units remembered per Python worker, and the characters handled between two look-ups: each hashes all remembered units.
REMEMBERED_UNITS = 700_000
BATCH_CHARS = 8_000_000
TEXTS_AT_ONCE = 2_048
# Texts whose ids are gathered at once.
GATHERED_TEXTS = 128
# Units encoded in one call, told apart afterwards by the ids that begin or divide them.
JOINED_UNITS = 5_000

_ADJACENT_SPACE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _byte_level(text: str) -> str:
    if _ADJACENT_SPACE.search(text):
        return _LONE_SPACE.sub("\0", text)
    # No white space next to white space: a line feed is a token of its own as well.
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ")


def _spaced_words(text: str) -> str:
    # The vocabulary is lower case; ASCII letters may be lowered here, so that fewer units differ.
    lower = text.lower() if text.isascii() else text
    return lower.replace("\n", " ")


def _final_mark(unit: str) -> bool:
    """A comma or full stop after a letter that stays one letter in lower case."""
    return unit[-1] in ",." and len(unit) > 1 and unit[-2].isalpha() and unit[-2] < "\u0130"


# How a text is marked, and the mark at which it is then cut into units.
_CUTS = {"byte_level": (_byte_level, "\0"), "spaced_words": (_spaced_words, " ")}


class Encoder:
    """Little-endian 32-bit ids of texts."""

    def __init__(self, vocabulary: str, boundary: str | None):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(vocabulary)
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # Units may be lowered, so a special token's string in any case counts.
        self._special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self._mark, self._cut = _CUTS[boundary] if boundary else (None, None)
        self._marks = boundary is not None
        self._boundary = boundary
        self._zero = self._tokenizer.encode("0", add_special_tokens=False).ids
        # Ids whose text begins with a space.
        self._opens = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._opens[[i for token, i in self._tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        # Remembered units, the ids of all side by side, how many each has, and whether it was met since some were last forgotten.
        self._units = pa.array([""], pa.large_string())
        self._ids, self._lengths, self._met = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.ones(1, bool)
        self._model = self._tokenizer.model
        self._final = self._learn([",", "."]) if self._marks else {}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = []
        batch: list[str] = []
        chars = 0
        for text in texts:
            if text and self._whole(text):
                out += self._batch(batch)
                out.append(array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                batch, chars = [], 0
                continue
            batch.append(text or "")
            chars += len(batch[-1])
            if chars >= BATCH_CHARS:
                out += self._batch(batch)
                batch, chars = [], 0
        return out + self._batch(batch)

    def _whole(self, text: str) -> bool:
        """Whether a text may hold a special token, or the mark that tells its units apart."""
        if self._cut == "\0" and "\0" in text:
            return True
        return bool(self._special and "<" in text and self._special.search(text))

    def _joins(self, unit: str) -> bool:
        """Whether a unit can be told apart in a joined text: printable, so without white space but its first."""
        if self._boundary == "spaced_words":
            return "0" not in unit and unit.isprintable()
        return self._boundary == "byte_level" and unit[0] == " " and len(unit) > 1 and " " not in unit[1:] and unit.isprintable()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units not known yet: many in one call, as units do not influence each other."""
        learned: dict[str, bytes] = {}
        if self._marks:
            # ASCII letters, after a space or not, are one piece, and what stands before the model changes no more than is done here.
            for unit in new:
                if unit.isascii() and (unit.isalpha() or self._boundary == "byte_level" and unit[:1] == " " and unit[1:].isalpha()):
                    piece = unit.replace(" ", "\u0120") if self._boundary == "byte_level" else unit.lower()
                    learned[unit] = array("I", [token.id for token in self._model.tokenize(piece)]).tobytes()
            new = list(set(new).difference(learned))
        apart = [] if len(self._zero) == 1 else new
        joined = [unit for unit in new if self._joins(unit)] if not apart else []
        apart = apart or list(set(new).difference(joined))
        for unit, found in zip(apart, self._tokenizer.encode_batch_fast(apart, add_special_tokens=False)):
            learned[unit] = array("I", found.ids).tobytes()
        by_zero = self._boundary == "spaced_words"
        for at in range(0, len(joined), JOINED_UNITS):
            units = joined[at : at + JOINED_UNITS]
            text = " 0 ".join(units) if by_zero else "".join(units)
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if by_zero:
                cuts = np.flatnonzero(ids == self._zero[0])
                starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            else:
                starts = np.flatnonzero(self._opens[ids])
                ends = np.append(starts[1:], len(ids))
            raw = ids.tobytes()
            for unit, a, b in zip(units, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                learned[unit] = raw[a:b]
        return learned

    def _batch(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self._mark:
            cut = pc.split_pattern(pa.array(map(self._mark, texts), pa.large_string()), self._cut)
            bounds, units = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        else:
            bounds, units = np.arange(len(texts) + 1), pa.array(texts, pa.large_string()).dictionary_encode()
        # Which remembered unit each unit of the texts is.
        numbers = self._numbers(units.dictionary)[units.indices.to_numpy()]
        starts = np.cumsum(self._lengths) - self._lengths
        out: list[bytes] = []
        for at in range(0, len(texts), GATHERED_TEXTS):
            here = bounds[at : at + GATHERED_TEXTS + 1]
            some = numbers[here[0] : here[-1]]
            taken = self._lengths[some]
            ends = np.append(0, np.cumsum(taken))
            raw = self._ids[np.arange(ends[-1]) + np.repeat(starts[some] - ends[:-1], taken)].tobytes()
            places = (4 * ends[here - here[0]]).tolist()
            out += [raw[a:b] for a, b in zip(places, places[1:])]
        self._forget()
        return out

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Where these units, which all differ, are among the remembered; new ones are learned and remembered."""
        number = lambda found: found.fill_null(-1).to_numpy()
        if self._marks:
            # A final mark is a token apart from the letters, so the bare unit is what is new.
            ending = pc.or_(pc.ends_with(units, ","), pc.ends_with(units, "."))
            bare = pc.utf8_slice_codeunits(units.filter(ending), 0, -1)
            both = number(pc.index_in(pa.concat_arrays([units, bare]), self._units))
            numbers, bares = both[: len(units)].copy(), np.full(len(units), -1)
            bares[ending.to_numpy(zero_copy_only=False)] = both[len(units) :]
        else:
            numbers = number(pc.index_in(units, self._units)).copy()
            bares = np.full(len(units), -1)
        self._met[numbers[numbers >= 0]] = True
        places = np.flatnonzero(numbers < 0)
        if not len(places):
            return numbers
        new = units.take(pa.array(places)).to_pylist()
        marked = [(unit, known) for unit, known in zip(new, bares[places].tolist()) if self._marks and _final_mark(unit)]
        needed = set(new).difference(unit for unit, _ in marked)
        learned = self._learn(list(needed.union(unit[:-1] for unit, known in marked if known < 0)))
        ends = np.cumsum(self._lengths).tolist() if marked else []
        for unit, known in marked:
            letters = learned[unit[:-1]] if known < 0 else self._ids[ends[known] - int(self._lengths[known]) : ends[known]].tobytes()
            learned[unit] = letters + self._final[unit[-1]]
        # New units first, in their order; then bare ones that stand in no text.
        order = new + list(learned.keys() - set(new))
        found = list(map(learned.__getitem__, order))
        numbers[places] = len(self._units) + np.arange(len(new))
        self._units = pa.concat_arrays([self._units, pa.array(order, pa.large_string())])
        self._ids = np.append(self._ids, np.frombuffer(b"".join(found), np.uint32))
        self._lengths = np.append(self._lengths, np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self._met = np.append(self._met, np.ones(len(found), bool))
        return numbers

    def _forget(self) -> None:
        """Keep the units met since the last time, half of the limit at most."""
        if len(self._units) <= REMEMBERED_UNITS:
            return
        kept = self._met.copy()
        kept[: np.flatnonzero(kept)[-max(1, REMEMBERED_UNITS // 2) :][0]] = False
        kept[0] = True
        self._ids = self._ids[np.repeat(kept, self._lengths)]
        self._units, self._lengths = self._units.filter(pa.array(kept)), self._lengths[kept]
        self._met = np.zeros(len(self._lengths), bool)


_ENCODERS: dict[tuple, Encoder] = {}


class Vocabulary:
    """A vocabulary file on its way to the executors."""

    def __init__(self, spark: SparkSession, path: str, boundary: str | None = None):
        with open(path, encoding="utf-8") as file:
            self._text = spark.sparkContext.broadcast(file.read())
        self._key = (path, boundary)

    def encoder(self) -> Encoder:
        """The encoder of this Python worker, made on first use and kept between tasks."""
        if self._key not in _ENCODERS:
            _ENCODERS[self._key] = Encoder(self._text.value, self._key[1])
        return _ENCODERS[self._key]
