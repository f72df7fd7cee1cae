"""Statistics of whole documents that quality rules and classifiers read."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import WORD, by_batch, stored

# Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares and means, of 0 where there is nothing to divide by.
RATIOS = (
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share",
    "punctuation_share", "other_share", "line_words", "end_share", "short_share", "top_word_share", "symbol_words",
)
FEATURES = (*COUNTS, *RATIOS)
SCHEMA = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)

_words = re.compile(WORD).findall
_symbols = re.compile(f"[{re.escape(SYMBOLS)}]").findall
_blank = str.maketrans("", "", " \t\n\x0b\x0c\r")


def repeated_words(words: list[str]) -> int:
    """Words inside a window of five that is found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            covered[i : i + WINDOW] = b"\1" * WINDOW
            covered[first : first + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def statistics(text: str | None) -> tuple:
    """The base counts and the ratios of one text; a null text has no words."""
    text = text or ""
    words = _words(text)
    n = len(words)
    word_chars = len(text.translate(_blank))
    symbols = len(_symbols(text))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = (n, word_chars, symbols, dup_lines, repeats)
    if not n:
        return (*counts, *(0.0 for _ in RATIOS))
    common: dict[str, int] = {}
    for w in words:
        common[w] = common.get(w, 0) + 1
    ascii_ = np.bincount(_KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)], minlength=6)
    upper, digits, marks, other = ascii_[1] / word_chars, ascii_[2] / word_chars, ascii_[3] / word_chars, ascii_[5] / word_chars
    ends = sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines) / len(lines)
    short = sum(c for w, c in common.items() if len(w) <= 2) / n
    marked = sum(c for w, c in common.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n
    return (
        *counts, word_chars / n, symbols / n, dup_lines / len(lines), repeats / n, len(common) / n, upper, digits, marks, other,
        n / len(lines), ends, short, max(common.values()) / n, marked,
    )


def _kinds() -> np.ndarray:
    """Kind of each ASCII character: 0 white space, 1 upper case, 2 digit, 3 mark, 4 lower case; 5 all others."""
    kinds = np.full(129, 3, dtype=np.int64)
    for c in range(128):
        x = chr(c)
        kinds[c] = 0 if x.isspace() else 1 if x.isupper() else 2 if x.isdigit() else 4 if x.islower() else 3
    kinds[128] = 5
    return kinds


_KINDS = _kinds()


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text and :data:`FEATURES` of every document, in one pass over the texts."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        columns = list(zip(*map(statistics, rows["text"]), strict=True))
        return {"doc_id": rows["doc_id"], "text_key": rows["text_key"], **dict(zip(FEATURES, columns, strict=True))}

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return by_batch(keyed, each, SCHEMA)


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about ``most`` different labelled documents, in a fixed order.

    Rows equal in id and text count once. They are chosen by a hash of both, so that one id with many texts is sampled like many ids.
    A fitted model reads no more than that; the rows of the sample are all that reaches the driver.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    known = stored(stats.join(known, "doc_id").dropDuplicates(["doc_id", "text_key"]), "labelled")
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(1)), F.lit(1_000_000))
    known = known.filter(share < max(1, int(1_000_000 * min(1.0, most / max(n, 1)))))
    table = known.select(*(F.col(c).cast("double") for c in FEATURES), F.col("label").cast("double"), "doc_id").toPandas()
    table = table.sort_values(["doc_id", *FEATURES], kind="stable")
    return table[list(FEATURES)].to_numpy(), table["label"].to_numpy().astype(int)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
