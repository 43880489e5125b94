"""The registered queries of operators 2, 3, 4, 6, 8, 9 and 10 on one small table, against brute force or their contract."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quiremill.llm import bpe, media, packing, quality, simhash, tokenfile, toxicity

WORDS = "stone river light market winter garden silver window letter bridge copper island forest summer signal harbor engine mirror".split()
SCHEMA = "doc_id long, text string, lang string, ids string, fp int, score double, tokens long, uid string, rest long"


def made():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "s", ".", "é", " 漢字"]) for _ in range(n))
    texts = [prose(r.randrange(1, 300)) for _ in range(24)]
    texts += [texts[0], texts[1].upper(), texts[2] + " end", None, "", " \t\n", "x", "a" * 5000, prose(9000), "</s> <s> [INST]", "1234567 　 ‘quoted’ 🙂 \x00 zero"]
    return [(100 - 3 * i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = made()
    rows += [rows[3], rows[3], (55_000, "second text of an id"), (55_000, "first text of an id")]
    spark.createDataFrame([(i, t, "en", "clash", 7, 0.5, 3, "u", 1) for i, t in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    r = random.Random(6)
    spark.createDataFrame([(i, r.randrange(2), r.randrange(2)) for i, _ in rows if i != 55_000], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op8(spark, given):
    rows, folder = given
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.op8_byte_bpe(spark, folder).collect())) == sorted(want)


def test_op9(spark, given):
    rows, folder = given
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lists = {}
    for i, t in rows:
        lists.setdefault(i, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = packing.op9_nnls_packing(spark, folder).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got, want = [], []
    for p in pieces:
        mine = [x for x in lists[p["doc_id"]] if len(x) == p["doc_tokens"] and crc(x[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]]
        assert mine
        got += [(p["doc_id"], p["doc_tokens"], k) for k in range(p["start"], p["start"] + p["length"])]
    for i, own in lists.items():
        want += [(i, len(x), k) for x in own for k in range(len(x))]
    assert sorted(got) == sorted(want)  # each id in exactly one piece
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048


def test_op10(spark, given):
    rows, folder = given
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(tokenfile.op10_elias_fano_token_file(spark, folder).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]


def test_op3(spark, given):
    rows, folder = given
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.setdefault(i, set()).add((len(raw), len(padded), sha(padded), zlib.crc32(padded[-16:]), t or ""))
    seen = {}
    got = media.op3_netpbm_media(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in want[r["doc_id"]] if x[:4] == (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])]
        assert len(own) == 1
        side = (r["payload_bytes"], r["media_bytes"], r["media_sha256"], r["feature"], r["tile"])
        assert seen.setdefault(own[0][4], side) == side  # equal texts, equal values
        padded = own[0][4].encode().ljust(r["payload_bytes"], b" ")
        head = r["media_bytes"] - r["payload_bytes"]
        sizes = [(w, r["payload_bytes"] // 3 // w) for w in range(1, r["payload_bytes"] // 3 + 1) if r["payload_bytes"] // 3 % w == 0]
        heads = [h for w, n in sizes if len(h := b"P6\n%d %d\n255\n" % (w, n)) == head]
        assert any(sha(h + padded) == r["media_sha256"] for h in heads)


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in low.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4(spark, given):
    rows, folder = given
    prints = [(i, brute_print(t or "")) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x][1] ^ prints[y][1]).bit_count() <= 4:
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(prints):
        least[find(x)] = min(i, least.get(find(x), i))
    want = sorted((i, f"{f:016x}", least[find(x)]) for x, (i, f) in enumerate(prints))
    assert sorted(map(tuple, simhash.op4_simhash_deletion_variants(spark, folder).collect())) == want


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op2_attention_mil_quality, "quality", 0.3), (toxicity.op6_noisy_channel_toxicity, "toxic", 0.5)])
def test_scores(spark, given, tmp_path, query, label, least):
    """Held-out rows by their checksum; scores are of the text alone, in range, and no held-out label counts."""
    rows, folder = given
    got = query(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    text, by = {}, {}
    for i, t in rows:
        text.setdefault(i, []).append(t or "")
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
        if len(set(text[r["doc_id"]])) == 1:
            assert abs(by.setdefault(text[r["doc_id"]][0], r["score"]) - r["score"]) < 1e-12
    # other labels of held-out rows, other columns, another order: the same scores
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").collect()
    docs.selectExpr("doc_id", "text", "'xx' AS lang", "'src' AS source").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    flipped = [(r["doc_id"], *((1 - r[c] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r[c]) for c in ("quality", "toxic"))) for r in labels]
    assert flipped != [tuple(r) for r in labels]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = query(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["score"])
    # products of other batches round apart in single precision
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(sorted(map(key, again)), sorted(map(key, got)), strict=True))


@pytest.mark.parametrize("query", [bpe.op8_byte_bpe, packing.op9_nnls_packing, tokenfile.op10_elias_fano_token_file, media.op3_netpbm_media, simhash.op4_simhash_deletion_variants])
def test_empty_tables(spark, tmp_path, query):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert query(spark, str(tmp_path)).collect() == []
