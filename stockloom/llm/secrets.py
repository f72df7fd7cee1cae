"""Secret scans: known patterns, and strings in sensitive places that zstandard cannot compress.

A candidate is a long string without blanks, a shorter one that is assigned to a name, the password of a URL, or what follows a known
token prefix. Its novelty is the number of bytes it adds when it is compressed between the text around it, by a compressor primed with
identifiers: a fixed list, and the commonest words of the corpus that names are made of. Strings made of known words add little for
each character, random ones about one byte. Its context is a sum of what is seen around it: a sensitive name before it, the nearer the
more (names begin and end at case changes, may be joined and in the plural), an assignment, quotes, an open PEM block, a URL, a prefix,
and kinds of characters. Candidates whose novelty and context together reach a threshold, and that touch no known pattern, are reported
as ``novel``. A name that ends its line with no mark between it and the string is a heading, not a name.

Null and empty texts have no spans; each row stands for itself, an empty table gives no rows; long texts are scanned whole. Spans count
code points, the end is exclusive; spans of one start are in the order of :data:`KINDS`. Columns besides ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import by_batch

# The patterns of known secrets and the least length of each.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "novel")

# Words near which a string may be a secret.
SENSITIVE = (
    "access", "account", "api", "auth", "authorization", "bearer", "cert", "certificate", "cookie", "credential", "credentials",
    "key", "login", "oauth", "passphrase", "passwd", "password", "private", "pwd", "secret", "session", "signature", "token",
)
# What identifiers in code and configuration are made of: the compressor's dictionary.
IDENTIFIERS = """
abstract access account action active address admin alias allow amount api app application archive args array assert async auth
authorization available await back backup base batch bearer begin block boolean branch break bucket buffer build byte bytes cache
call callback cancel case catch certificate change channel char check child class clean client clone close cluster code column
command commit common compare config configuration confirm connect connection console const constant container content context
continue control convert cookie copy count counter create credential credentials current cursor custom data database date datetime
debug decode default delete deploy description destination device dictionary directory disable display distance document domain
double download driver dynamic element email enable encode encoding encrypt endpoint engine entry enum environment error event
example except exception execute exit expire export expression extension external factory false field file filter final finally
find first float folder for format from function gateway generate get global graph group handle handler hash header health height
hidden history host html http https identifier image import include index info init initialize input insert instance integer
interface internal interval invalid item iterator job join json key label language last layer length level library license limit
line link list load local location lock log login logout long loop main manager manifest map master match max member memory message
metadata method metric middle min mode model module monitor mount name namespace network next node none normal notification null
number object offset open operation operator option order origin output override owner package page parameter params parent parse
password patch path pattern payload permission phone pipeline platform plugin point pointer policy pool port position prefix
private process processor produce profile project property protocol provider proxy public publish query queue random range rate
raw read record reference refresh region register release remote remove render replace report repository request require reset
resource response rest result retry return role root route row rule run runtime sample schedule schema scope score script search
secret section secure security select self send sequence serial server service session set setting setup shard share shell short
signature size socket sort source spec stack stage start state static status stop storage store stream string struct submit success
summary super support switch sync system table tag target task team template tenant test text thread throw time timeout timestamp
title token tool topic total trace transaction transform transport true type unique unit update upload url usage user username util
valid validate value variable vector version view virtual void volume wait warning web while width window worker workflow workspace
wrapper write xml yaml zone = : ( ) { } [ ] " ' , ; get_ set_ is_ has_ _id _key _name _path _url _token _secret client_id client_secret
access_token refresh_token api_key private_key public_key user_name password= token= secret= key= Bearer Basic Authorization:
"""

# Public prefixes of access tokens.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-", "xoxa-", "AIza", "ya29.", "npm_", "SG.", "eyJ")

#: Novelty and context together; novelty alone, of a short string, of letters joined like a name, that a report needs.
THRESHOLD, NOVEL, NOVEL_SHORT, NOVEL_NAME = 0.95, 0.5, 0.4, 0.75
#: What each sight of a context adds; a name counts less the further away it stands.
NAMED, FAR_NAMED, ASSIGNED, QUOTED, CERTAIN, KIND = 0.35, 0.1, 0.15, 0.05, 0.5, 0.04
BEFORE, AFTER, NEAR, LEAST, SHORT = 256, 128, 256, 16, 8
#: Words of the corpus in the compressor's dictionary.
CORPUS_WORDS = 3000

_assign = re.compile(ASSIGN).finditer
_access = re.compile(ACCESS).finditer
_hex = re.compile(HEX).finditer
_WIDE = r"A-Za-z0-9+/_=.!@#$%^&*~?-"
_candidate = re.compile(rf"(?<![{_WIDE}])[{_WIDE}]{{{LEAST},}}").finditer
_assigned = re.compile(rf"""(?:[:=]|=>)[\x20\t]*["'`]?([{_WIDE}]{{{SHORT},}})""").finditer
_password = re.compile(rf"://[^\s/:@]*:([^\s/@]{{{SHORT},}})@").finditer
_prefixed = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, PREFIXES))})[A-Za-z0-9._-]{{{LEAST},}}").finditer
_value = re.compile("(?<==)[^=]").finditer  # what follows a name in the same string
# addresses of mail and machines are no secrets
_address = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+\W*|\d{1,3}(?:\.\d{1,3}){3}\W*").fullmatch
_joined = re.compile(r"[A-Za-z]+(?:[_./-]+[A-Za-z]*)+|(?:[A-Z]?[a-z]{2,}){2,}").fullmatch
_word = re.compile(r"[A-Z]?[a-z]{2,}").findall
_camel = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_name = rf"(?:(?<![A-Za-z])|{_camel})(?ai:(?:{'|'.join(SENSITIVE)})+(?:e?s)?)(?:(?![A-Za-z])|{_camel})"
_sensitive = re.compile(rf"{_name}(?![^\S\n]*\n\s*\Z)").search
_names = re.compile(rf"{_name}(?![^\S\n]*\n\s*\Z)").finditer
_marker = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----").sub
_pem = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----").finditer
#: What a text with an assignment contains in lower case.
WORDS = ("passw", "secret", "token", "api")

Span = tuple[int, int, int]  # start, kind, end


def known_spans(text: str) -> list[Span]:
    """Spans of the known patterns, by start and kind."""
    spans: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in _assign(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _access(text)]
    spans += [(m.start(), 2, m.end()) for m in _hex(text)]
    return sorted(spans)


class Novelty:
    """Marginal compressed bytes of a string between its surroundings."""

    def __init__(self, words: Sequence[str] = (), dictionary: str = IDENTIFIERS, level: int = 19):
        dictionary = " ".join([*words, dictionary]).lower()
        data = zstandard.ZstdCompressionDict(" ".join(dictionary.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=4096, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compressor = zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.lower().encode("utf-8", "surrogatepass")))

    def of(self, text: str, start: int, end: int) -> float:
        """Added bytes for each character of ``text[start:end]``, written behind the text that surrounds it.

        Behind it, because a string inserted into a run of matches can also save bytes; without case, so that words are known in any.
        A few bytes more can change how a block is stored, so the middle one of three surroundings counts.
        """
        before, after, string = text[max(0, start - BEFORE) : start], text[end : end + AFTER], text[start:end]
        added = sorted(self.size(around + string) - self.size(around) for around in (before + after + "\n", before + "\n", after + "\n"))
        return added[1] / (end - start)


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Where PEM blocks of a sensitive kind are open: from the header to its END line, or to the end of the text."""
    blocks = []
    for m in _pem(text) if "-----BEGIN" in text else ():
        if _sensitive(m[1]):
            end = text.find(f"-----END {m[1]}-----", m.end())
            blocks.append((m.end(), end if end >= 0 else len(text)))
    return blocks


def candidates(text: str) -> dict[tuple[int, int], bool]:
    """Spans that may be a secret, and whether their place alone says so."""
    found: dict[tuple[int, int], bool] = {}

    def add(start: int, end: int, certain: bool = False) -> None:
        while end > start and text[end - 1] in ".!?":
            end -= 1
        if end - start >= SHORT:
            found[start, end] = found.get((start, end), False) or certain

    for m in _candidate(text):
        add(*m.span())
        for i in _value(m.group()):
            if m.end() - m.start() - i.start() >= SHORT:
                add(m.start() + i.start(), m.end())
    for m in _assigned(text):
        add(*m.span(1))
    if "://" in text:
        for m in _password(text):
            add(*m.span(1), True)
    for m in _prefixed(text):
        add(*m.span(), True)
    return found


def context(text: str, start: int, end: int) -> float:
    """What the surroundings of a string add to its score."""
    before = _marker(lambda m: " " * len(m[0]), text[max(0, start - NEAR) : start])
    out, named, straight = 0.0, None, before.rstrip(" \t\"'`")
    for m in _names(before):
        named = m
    assigned = straight.endswith((":", "=", "=>")) and not straight.endswith(("://", "=="))
    if named:
        out += NAMED - (NAMED - FAR_NAMED) * max(0, len(before) - named.end() - 16) / NEAR
        out += ASSIGNED if assigned else 0.0
    if before[-1:] in ("'", '"', "`") and text[end : end + 1] == before[-1:]:
        out += QUOTED
    string = text[start:end]
    kinds = sum(any(f(c) for c in string) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return out + KIND * kinds


def novel_spans(text: str, known: list[Span], novelty: Novelty) -> list[Span]:
    spans: list[Span] = []
    blocks = pem_blocks(text)
    taken = [(a, b) for a, _, b in known]
    for (start, end), certain in sorted(candidates(text).items(), key=lambda c: (c[0][0], -c[0][1])):
        if any(a < end and start < b for a, b in taken):
            continue
        certain = certain or any(a <= start < b for a, b in blocks)
        seen = context(text, start, end) + (CERTAIN if certain else 0.0)
        if seen < ASSIGNED + KIND or end - start < SHORT:
            continue  # no name, block, URL or prefix
        string = text[start:end]
        if not certain and (_address(string) or string.startswith("//") and text[start - 1 : start] == ":"):
            continue
        if not certain and end - start < LEAST and (seen < NAMED or string.isdigit() or _joined(string) or string in (string.lower(), string.upper(), string.title()) and string.isalpha()):
            continue
        new = novelty.of(text, start, end)
        least = NOVEL_NAME if _joined(string) else NOVEL if end - start >= LEAST else NOVEL_SHORT
        if new >= least and new + seen >= THRESHOLD:
            spans.append((start, 3, end))
            taken.append((start, end))
    return spans


def find_spans(text: str | None, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """Known spans, and all spans in order."""
    known = known_spans(text or "")
    return known, sorted(known + novel_spans(text or "", known, novelty))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The commonest words that names and prose of the corpus are made of, the commonest last, where a match costs least.

    All texts are counted; a word counts once a text, and only the list reaches the driver. Words are letters alone, so a secret that
    is copied often cannot make itself known.
    """

    def each(rows: dict[str, list]) -> dict[str, list]:
        counts: Counter[str] = Counter()
        for text in rows["text"]:
            if text:
                counts.update({w.lower() for w in _word(text)})
        return {"word": list(counts), "n": list(counts.values())}

    counted = by_batch(docs.select("text"), each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.filter(F.length("word").between(3, 24)).orderBy(F.col("n").desc(), "word").limit(most).collect()
    return [r["word"] for r in reversed(found)]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans`` of every document."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    words = corpus_words(docs)

    def each(rows: dict[str, list]) -> dict[str, list]:
        novelty = primed(words)
        found = [find_spans(t, novelty) for t in rows["text"]]
        counts = {f"n_{name}": [sum(k == i for _, k, _ in every) for _, every in found] for i, name in enumerate(KINDS)}
        return {
            "doc_id": rows["doc_id"], **counts,
            "base_sha256": [hashlib.sha256(written(known).encode()).hexdigest() for known, _ in found],
            "spans": [written(every) for _, every in found],
        }

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, schema)


def primed(words: list[str], made: dict = {}) -> Novelty:  # noqa: B006
    """One compressor a worker and dictionary."""
    key = tuple(words)
    if key not in made:
        made.clear()
        made[key] = Novelty(key)
    return made[key]


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced; ``n_chars``, if there is one, follows."""
    names = docs.columns
    counted = "n_chars" in names
    words = corpus_words(docs)

    def each(rows: dict[str, list]) -> dict[str, list]:
        novelty = primed(words)
        for i, text in enumerate(rows["text"]):
            spans = find_spans(text, novelty)[1]
            if spans:
                rows["text"][i] = redacted(text, spans, mark)
                if counted:
                    rows["n_chars"][i] = len(rows["text"][i])
        return rows

    return by_batch(docs, each, docs.schema)
