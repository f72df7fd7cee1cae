"""Language identification by words first, then by ever shorter character n-grams.

A word that the model knows scores by its frequency in each language. Any other word is padded and cut into its n-grams, longest
first: the first length of which some n-gram is known scores the word by the mean over its n-grams. The language of the smallest mean
penalty wins; ties go to the first by code point.

The score is the winner's share when penalties, weighed by the square root of the number of words, are turned into probabilities.
A null text, or one without letters, is ``und`` with score 0; without any training document every text is. Null languages are not
learned. Repeated rows are judged alike, an empty table gives no rows. Columns besides ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.docstats import held_out
from stockloom.llm.shared import by_batch

#: Documents of one language that are counted, and how often a word or n-gram must be found in it.
DOCS_PER_LANGUAGE = 4_000
LEAST_COUNT = 2
LONGEST_GRAM = 5
ROOM = 150_000
TOGETHER = 64



def _ranges(*kinds: str) -> str:
    """All characters of these Unicode categories, for a character class."""
    found: list[list[int]] = []
    for i in range(0x20000):
        if unicodedata.category(chr(i)) in kinds:
            if found and found[-1][1] == i - 1:
                found[-1][1] = i
            else:
                found.append([i, i])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in found)


# a word is letters, and the marks on them; numbers of any kind are none
_LETTER = rf"[^\W\d_{_ranges('No', 'Nl')}]"
_words = re.compile(rf"{_LETTER}+(?:[{_ranges('Mn', 'Mc', 'Me')}]+{_LETTER}*)*").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Table:
    """Entries in the order of their XXH64 hash, each with its penalties in the languages that have it.

    All are flat arrays: ``text[ends[i]:ends[i + 1]]`` is entry ``i``, its languages and penalties lie from ``starts[i]`` on.
    """

    def __init__(self, width: int, unknown: float, keys: np.ndarray, text: bytes, ends: array, starts: np.ndarray, languages: np.ndarray, penalties: np.ndarray):
        self.plain = (width, unknown, keys, text, ends, starts, languages, penalties)
        self.width, self.unknown, self.keys, self.text, self.ends, self.starts, self.languages, self.penalties = self.plain

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[str]:
        return (self.text[self.ends[i] : self.ends[i + 1]].decode() for i in range(len(self)))

    def find(self, entries: list[str]) -> np.ndarray:
        """Places of the entries, -1 for unknown ones."""
        raw = [e.encode() for e in entries]
        hashed = np.frombuffer(b"".join([xxhash.xxh64_digest(r, 42) for r in raw]), ">u8").astype(np.uint64).view(np.int64)
        places = np.searchsorted(self.keys, hashed)
        found = np.zeros(len(raw), dtype=bool)
        inside = places < len(self)
        found[inside] = self.keys[places[inside]] == hashed[inside]
        text, ends = self.text, self.ends
        for k, i in zip(np.flatnonzero(found).tolist(), places[found].tolist(), strict=True):
            if text[ends[i] : ends[i + 1]] != raw[k]:  # another entry of the same hash
                same = range(i + 1, int(np.searchsorted(self.keys, hashed[k], "right")))
                places[k] = next((j for j in same if text[ends[j] : ends[j + 1]] == raw[k]), -1)
        return np.where(found, places, -1)

    def __getitem__(self, entry: str) -> int:
        if (i := int(self.find([entry])[0])) < 0:
            raise KeyError(entry)
        return i

    def means(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean penalties in each language over groups of so many places; an unknown entry, -1, has the same in all."""
        groups = np.repeat(np.arange(len(sizes)), sizes)[places >= 0]
        first = self.starts[places[places >= 0]]
        counts = self.starts[places[places >= 0] + 1] - first
        at = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
        cells = np.repeat(groups, counts) * self.width + self.languages[at]
        sums = np.bincount(cells, self.penalties[at] - self.unknown, minlength=len(sizes) * self.width)
        return self.unknown + sums.reshape(len(sizes), self.width) / np.maximum(sizes, 1)[:, None]


class Rows:
    """Penalties of a table's entries in all languages, by place."""

    def __init__(self, table: Table):
        self.table = table

    def __getitem__(self, i: int) -> np.ndarray:
        return self.table.means(np.array([i]), np.array([1]))[0]


@dataclass(frozen=True)
class Model:
    """Penalties (minus the decimal logarithm of the frequency) of every known word and n-gram in each language."""

    languages: list[str]
    words: Table
    grams: list[Table]  # by length, from 1
    unknown: float

    @property
    def word_rows(self) -> Rows:
        return Rows(self.words)

    def penalties(self, words: list[str]) -> np.ndarray:
        places = self.words.find(words)
        out = self.words.means(places, np.ones(len(words), dtype=int))
        others = np.flatnonzero(places < 0)
        if len(others):
            out[others] = self.backoffs([words[i] for i in others.tolist()])
        return out

    def backoff(self, word: str) -> np.ndarray:
        return self.backoffs([word])[0]

    def backoffs(self, words: list[str]) -> np.ndarray:
        out = np.full((len(words), len(self.languages)), self.unknown)
        left = np.arange(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            cut = [grams(words[i], n) for i in left.tolist()]
            sizes = np.array([len(c) for c in cut], dtype=int)
            places = self.grams[n - 1].find([g for c in cut for g in c])
            some = np.bincount(np.repeat(np.arange(len(left)), sizes)[places >= 0], minlength=len(left)) > 0
            out[left[some]] = self.grams[n - 1].means(places, sizes)[some]
            left = left[~some]
            if not len(left):
                break
        return out


class Places(dict):
    """Rows of the words met; a new word gets its row from ``add``."""

    def __init__(self, add: Callable[[list[str]], None]):
        self.add = add

    def __missing__(self, word: str) -> int:
        self.add([word])
        return self[word]


class Scorer:
    """Applies a model, remembering the rows of at most ``ROOM`` words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.empty((ROOM, len(model.languages)), dtype=np.float32)
        self.places = Places(self.add)

    def add(self, new: list[str]) -> None:
        """Give rows to new words, at most ``ROOM``; if there is no room left, all others are forgotten."""
        if len(self.places) + len(new) > len(self.rows):
            self.places.clear()
        used = len(self.places)
        self.rows[used : used + len(new)] = self.model.penalties(new)
        self.places.update(zip(new, range(used, used + len(new)), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The words of some texts are looked up together."""
        out = []
        for start in range(0, len(texts), TOGETHER):
            found = [*map(words_of, texts[start : start + TOGETHER])]
            new = set().union(*found).difference(self.places)
            if new and len(new) <= ROOM // 2:
                self.add([*new])
            out += map(self.of_words, found)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.of_words(words_of(text))

    def of_words(self, words: list[str]) -> tuple[str, float]:
        languages = self.model.languages
        if not words or not languages:
            return "und", 0.0
        total = np.zeros(len(languages))
        for start in range(0, len(words), ROOM // 2):
            part = words[start : start + ROOM // 2]
            found = [*map(self.places.get, part)]
            if None in found:
                new = [*{w for w, i in zip(part, found, strict=True) if i is None}]
                if len(self.places) + len(new) > ROOM:
                    self.places.clear()
                    new = [*set(part)]
                self.add(new)
                found = [*map(self.places.__getitem__, part)]
            total += self.rows[found].sum(axis=0, dtype=np.float64)
        mean = total / len(words)
        best = int(mean.argmin())
        odds = 10 ** (-(mean - mean[best]) * len(words) ** 0.5)
        return languages[best], float(1 / odds.sum())


def _learns(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, least_count: int = LEAST_COUNT) -> Model:
    """Count words and n-grams of documents that are not held out.

    About ``docs_per_language`` different documents of each language are counted, chosen by a hash of id and text. Of each language the
    words and n-grams found ``least_count`` times are kept, however many these are: the sample alone bounds what reaches the driver and
    the tasks. A kept entry has its counts of all languages.
    """
    fits = docs.filter(_learns(F.col("doc_id")) | F.col("doc_id").isNull()).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    fits = fits.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("key"))
    different = fits.select("lang", "doc_id", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    sizes = {r["lang"]: r["docs"] for r in different.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], _empty(0), [_empty(0)] * LONGEST_GRAM, 0.0)
    # a literal of one number a language: only texts of the sample are shuffled
    shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, docs_per_language / sizes[lang])))
    place = F.pmod(F.xxhash64("doc_id", "key", F.lit(2)), F.lit(1_000_000)) / 1_000_000
    sample = fits.filter(place < F.element_at(shares, F.col("lang"))).dropDuplicates(["lang", "doc_id", "key"])

    def each(rows: dict[str, list]) -> dict[str, list]:
        counts: dict[tuple[str, int], Counter] = {}
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in by_lang.items():
            counts[lang, 0] = found
            for n in range(1, LONGEST_GRAM + 1):
                of_length = counts[lang, n] = Counter()
                for word, c in found.items():
                    for g in grams(word, n):
                        of_length[g] += c
        flat = [(lang, n, entry, c) for (lang, n), found in counts.items() for entry, c in found.items()]
        columns = zip(*flat, strict=True) if flat else ([], [], [], [])
        return dict(zip(("lang", "length", "entry", "n"), map(list, columns), strict=True))

    counted = by_batch(sample.select("lang", "text"), each, "lang string, length int, entry string, n long")
    counted = counted.groupBy("lang", "length", "entry").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "length"))
    own = F.max("n").over(Window.partitionBy("length", "entry")) >= least_count
    kept = counted.withColumn("total", total).withColumn("own", own).filter("own")
    kept = kept.select("length", F.xxhash64("entry").alias("key"), "entry", "lang", "n", "total").toArrow()
    return _model(languages, kept.sort_by([(c, "ascending") for c in ("length", "key", "entry", "lang")]))


def _empty(width: int, unknown: float = 0.0) -> Table:
    return Table(width, unknown, np.zeros(0, np.int64), b"", array("q", [0]), np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32))


def _model(languages: list[str], counts: pa.Table) -> Model:
    """The model of the counts ``length, key, entry, lang, n, total`` in this order."""
    width = len(languages)
    unknown = 1.0 + float(np.log10(max(pc.max(counts["total"]).as_py(), 1))) if len(counts) else 1.0
    lengths = counts["length"].to_numpy()
    tables = []
    for n in range(LONGEST_GRAM + 1):
        first, last = np.searchsorted(lengths, [n, n + 1])
        part = counts.slice(first, last - first)
        if not len(part):
            tables.append(_empty(width, unknown))
            continue
        entries = pa.concat_arrays(part["entry"].cast(pa.large_binary()).chunks)
        starts = np.flatnonzero(np.r_[True, pc.not_equal(entries[1:], entries[:-1]).to_numpy(zero_copy_only=False)])
        entries = entries.take(pa.array(starts))
        ends = np.frombuffer(entries.buffers()[1], np.int64)[: len(entries) + 1]
        penalties = -np.log10(part["n"].to_numpy() / part["total"].to_numpy())
        tables.append(Table(
            width, unknown, part["key"].to_numpy()[starts], entries.buffers()[2].to_pybytes()[: ends[-1]],
            array("q", ends.tobytes()), np.r_[starts, len(part)],
            pc.index_in(part["lang"], pa.array(languages)).to_numpy().astype(np.uint16), penalties.astype(np.float32),
        ))
    return Model(languages, tables[0], tables[1:], unknown)


def predict_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; predictions read the text only."""
    learned = learn(docs)
    # plain values: a broadcast is pickled by reference to its classes
    values = (learned.languages, learned.words.plain, [t.plain for t in learned.grams], learned.unknown)
    model = docs.sparkSession.sparkContext.broadcast(values)

    class Kept:
        scorer: Scorer | None = None

    def each(rows: dict[str, list]) -> dict[str, list]:
        if Kept.scorer is None:
            languages, words, grams, unknown = model.value
            Kept.scorer = Scorer(Model(languages, Table(*words), [Table(*t) for t in grams], unknown))
        found = Kept.scorer.predict_all(rows["text"])
        return {
            "doc_id": rows["doc_id"], "held_out": [held_out(x) for x in rows["doc_id"]],
            "lang_pred": [x for x, _ in found], "score": [x for _, x in found],
        }

    return by_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each,
        "doc_id long, held_out boolean, lang_pred string, score double",
    )
