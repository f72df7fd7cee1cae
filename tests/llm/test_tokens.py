import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from stockloom.llm import packing, tokenfile
from stockloom.llm.bpe import WordEncoder

TRICKY = [
    "", "  a  b \n\n c", " x", "x ", "\t\tq\n", "l'été's don't 1234 x+=1  \n", "a\xa0 b", "\x1c!\x1cab \x85 z", "é ́x", "ΑΣ ΣΑ İ", "\n", "\n\n",
    "<|endoftext|> a<|startoftext|>b", "🙂🙂 a", "a\n.\nb\n\n\nc\n", "foo.Bar's 'tis x.'s", "éa.b,É-ß", "\na", "a\n", " \na\n ", "DON'T", "x" * 300,
]


def ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, keeps):
    encoder = WordEncoder(name, keeps, room=10)
    for text in TRICKY * 2:
        assert encoder.encode(text) + b"\0\0\0\0" == ids(name, text)
        assert len(encoder.known) <= 10


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>y\n", "A <|EndOfText|> B", "é <|ENDOFTEXT|>\xa0z", "<|endoftext|", "a<|endoftext|>  \n b c"]


def plain_ids(name, text):
    return np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_strings(name, keeps):
    encoder = WordEncoder(name, keeps, room=10, escape=False)
    for text in [*TRICKY, *SPECIAL] * 2:
        assert encoder.encode(text) == plain_ids(name, text)


def test_special_strings_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    packed = {r["doc_id"]: bytes(r["ids"]) for r in packing.pack_documents(docs, with_ids=True).collect()}
    tokenfile.write_token_files(docs, str(tmp_path / "a"))
    filed = {r["doc_id"]: bytes(r["ids"]) for r in tokenfile.read_token_files(spark, str(tmp_path / "a")).collect()}
    assert packed == {i: plain_ids("word_bpe_49k.json", t) + bytes(4) for i, t in enumerate(SPECIAL)}
    assert filed == {i: plain_ids("byte_bpe_50k.json", t) + bytes(4) for i, t in enumerate(SPECIAL)}


def test_file_format():
    out = io.BytesIO()
    writer = tokenfile.FrameWriter(out)
    parts = [(None, b"\1\0\0\0"), (-3, b""), (5, bytes(4000)), (5, b"abcd")]
    for doc_id, data in parts:
        writer.add(doc_id, data)
    writer.close()
    raw = out.getvalue()
    reader = tokenfile.FrameReader(io.BytesIO(raw), len(raw))
    assert [(i, reader.frame(n)) for n, i in enumerate(reader.ids)] == parts
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert whole.decompress(raw) == b"".join(d for _, d in parts)
    damaged = bytearray(raw)
    damaged[int(reader.starts[2]) + 8] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.FrameReader(io.BytesIO(bytes(damaged)), len(raw)).frame(2)
    with pytest.raises(ValueError):
        tokenfile.FrameReader(io.BytesIO(raw + b"."), len(raw) + 1)
    empty = io.BytesIO()
    tokenfile.FrameWriter(empty).close()
    assert tokenfile.FrameReader(empty, len(empty.getvalue())).ids == []


def test_files(spark, docs, rows, none, tmp_path, monkeypatch):
    monkeypatch.setattr("stockloom.llm.shared.part_count.__defaults__", ("text", 20_000))
    tokenfile.write_token_files(docs, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("ids-*.zst"))) > 3
    got = sorted((r for r in tokenfile.read_token_files(spark, str(tmp_path / "a")).collect()), key=lambda r: r["start"])
    start = 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        data = ids("byte_bpe_50k.json", w[1] or "")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"], bytes(g["ids"])) == (w[0], start, len(data) // 4, zlib.crc32(data), data)
        start += len(data) // 4
    some = tokenfile.read_token_files(spark, str(tmp_path / "a"), [7, 130, 9999], with_ids=False).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == [(g["doc_id"], g["start"]) for g in got if g["doc_id"] in (7, 130)]
    tokenfile.write_token_files(none, str(tmp_path / "b"))
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    got = packing.pack_documents(docs, capacity=256, with_ids=True).collect()
    want = []
    for doc_id, text, *_ in rows:
        data = ids("word_bpe_49k.json", text or "")
        for piece, at in enumerate(range(0, len(data), 1024)):
            part = data[at : at + 1024]
            want.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 256)
    assert len({r["sequence_id"] for r in got}) <= 1.05 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack_documents(none).count() == 0


def check_sequences(rows, capacity):
    rooms = {}
    for s, offset, length in sorted(rows):
        assert offset == rooms.get(s, 0)
        rooms[s] = offset + length
        assert rooms[s] <= capacity


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(r)
            place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    fixed = 0
    for _ in range(300):
        capacity = int(rng.integers(8, 24))
        lengths = rng.integers(1 + capacity // 5, capacity + 1, size=int(rng.integers(1, 9))).tolist()
        stock = packing.Stock({x: lengths.count(x) for x in lengths}, capacity)
        kinds = packing.reduce(stock, capacity)
        left = [x for x in range(capacity + 1) for _ in range(int(stock.left[x]))]
        n = sum(n for n, _ in kinds)
        fixed += n
        assert n + fewest(left, capacity) == fewest(lengths, capacity)
        assert sorted(left + [x for n, p in kinds for _ in range(n) for x, c in p for _ in range(c)]) == sorted(lengths)
    assert fixed > 300


def test_best_fit_of_equal_pieces_is_that_of_single_ones():
    rng = np.random.default_rng(4)
    for _ in range(200):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, size=int(rng.integers(0, 60))).tolist()
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                rooms.append(capacity - x)
            else:
                rooms.remove(room)
                rooms.append(room - x)
        kinds = packing.best_fit(packing.Stock({x: lengths.count(x) for x in lengths}, capacity), capacity)
        assert sorted(r for n, p in kinds for r in [capacity - sum(x * c for x, c in p)] * n) == sorted(rooms)


def test_places():
    kinds = [(3, [(5, 2), (2, 1)]), (1, [(5, 1)])]
    runs = packing.places(kinds, 12)
    assert [tuple(int(v) for v in r) for r in zip(*runs.values(), strict=True)] == [(2, 0, 0, 1, 10), (5, 0, 0, 2, 0), (5, 6, 3, 1, 0)]
