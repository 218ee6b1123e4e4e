import zlib
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from flowlens.llm import packing, planes
from flowlens.llm.encoding import Encoder
from tokenizers import Tokenizer

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


_tokenizer = cache(Tokenizer.from_file)


def plainly(path, text):
    return _tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_stretches_give_the_ids_of_the_whole(path, plain):
    odd = ["", " ", "\n\n", "a  b\n\n c", "\t x", "x\t y", "é  z", "don't  'tis", "ab", "  lead", "tail \n ", "(x) (y)", "x\n(y)", "ab\r\ncd", "<|endoftext|> x", "A1b2 fooжbar, éœx", "x" * 200 + " y", "it's we'll I'd-X"]
    encoder = Encoder.of(path)
    for _ in range(2):
        for text, got in zip([*plain.values(), *odd], encoder.encode([*plain.values(), *odd]), strict=True):
            assert array("I", plainly(path, text)).tobytes() == got, text[:50]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint64).astype(np.uint32)
    assert (planes.join_planes(planes.split_planes(ids, bits), len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_all_documents_in_order(spark, docs, plain, tmp_path, bits):
    folder = f"file://{tmp_path}/ids"
    manifest = planes.write_ids(docs, folder, WORDS, end_id=2, block=512, bits=bits)
    rows = sorted(planes.read_ids(spark, folder).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in rows:
        ids = [*plainly(WORDS, plain[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), array("I", ids).tobytes())
        start += len(ids)
    assert [r["doc_id"] for r in rows] == sorted(plain) and sum(r["tokens"] for r in manifest.collect()) == start


def test_a_block_is_found_by_the_index(tmp_path):
    import pyarrow as pa

    with (tmp_path / "f").open("wb") as out:
        w = planes.PlaneWriter(out, pa.int64(), block=8)
        for k in range(5):
            w.add(k, array("I", range(10 * k, 10 * k + 7)).tobytes())
        w.close()
    with (tmp_path / "f").open("rb") as source:
        r = planes.PlaneReader(source, (tmp_path / "f").stat().st_size)
        assert r.block(1).tolist() == [11, 12, 13, 14, 15, 16, 20, 21]
        assert [k for k, _ in r.documents()] == list(range(5))
    (tmp_path / "g").write_bytes((tmp_path / "f").read_bytes()[:-3])
    with (tmp_path / "g").open("rb") as source, pytest.raises(ValueError):
        planes.PlaneReader(source, (tmp_path / "g").stat().st_size)


def test_levels_choose_the_least_sum_of_squares():
    rng, w = np.random.default_rng(2), 32
    levels = packing.Levels(w)
    for i in range(300):
        size = int(rng.integers(1, w))
        before = levels.counts.copy()
        sums = {}
        for h in [0, *np.flatnonzero(before[1:w]) + 1]:
            if h + size <= w:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < w
                sums[int(h)] = int((after**2).sum())
        chosen = levels.level_for(size)
        assert sums[chosen] == min(sums.values())
        list(levels.put((i, 0, b"\0\0\0\0" * size, size)))
        assert all(sum(len(p[2]) // 4 for p in x) == h for h, xs in enumerate(levels.open) for x in xs)


def test_packing_keeps_every_id_once(docs, plain):
    rows = packing.pack(docs, BYTES, end_id=1, window=256).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(plain)
    for i, pieces in by_doc.items():
        ids, at = [*plainly(BYTES, plain[i]), 1], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)
    partial = 0
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
        partial += at < 256
    assert partial <= 8


def test_empty_tables(spark, empty, tmp_path):
    assert packing.pack(empty, BYTES).count() == 0
    planes.write_ids(empty, f"file://{tmp_path}/none", WORDS)
    assert planes.read_ids(spark, f"file://{tmp_path}/none").count() == 0
