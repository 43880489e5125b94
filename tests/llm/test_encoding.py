"""Operators 8, 9, 10 and 1: encoders, packing, token files, chat."""

import os
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quiremill.llm import bpe, chat, packing, tokenfile

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS, BYTES, WORDS = (public.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "a", "The", "'s", "'LL", "é", "É", "ß", "ΟΔΟΣ", "İ", "é", "日本", "🙂", "1", "²", "½", "Ⅷ", "!!", "...", "_", "\xad", "​", "ª", "<|endoftext|>", "ﬁ", "a" * 70, "=" * 100, "\x00", "ab" * 40, "ſ", "　"]


def made(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(25))) for _ in range(n)] + ["", " ", "\n", " a", "a ", "a\n", "\na \n b"]


@pytest.fixture(scope="module")
def references():
    tik = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    by, wo = bpe.library(BYTES), bpe.library(WORDS)
    return {
        "ranks": (bpe.ranked_encoder(RANKS), tik.encode_ordinary),
        "bytes": (bpe.json_encoder(BYTES), lambda x: by.encode(x, add_special_tokens=False).ids),
        "words": (bpe.json_encoder(WORDS), lambda x: wo.encode(x, add_special_tokens=False).ids),
    }


@pytest.mark.parametrize("kind", ["ranks", "bytes", "words"])
def test_encoder_equals_library(references, kind):
    encoder, want = references[kind]
    texts = made(800)
    for _ in range(2):  # the second time from memory
        for t, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == list(want(t)), t


def test_bounded_memory(references, monkeypatch):
    encoder, want = references["ranks"]
    monkeypatch.setattr(bpe, "PIECES", 5)
    encoder.young.clear(), encoder.old.clear()
    texts = made(50, 9)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [want(t) for t in texts]
    assert len(encoder.young) <= 10 and len(encoder.old) <= 10


@pytest.mark.parametrize("kind", ["ranks", "bytes", "words"])
def test_sections_and_mixed_slices(references, kind, monkeypatch):
    """Texts cut into sections, and texts that share a slice with others, have the ids that they have alone."""
    encoder, want = references[kind]
    texts = [*made(400, 21), *("".join(made(40, s)) for s in range(30)), "it's we're 'tis ''s x'll9 'LL 've're 'm", "a" * 50 + " 's \n\n 't"]
    whole = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == whole == [list(want(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stmdrevlLaZé1² \n\t!.…日ΣİΩ½\x1c\xa0\u2003"), max_size=30), max_size=6))
def test_cut_equals_library(references, texts):
    for encoder, want in references.values():
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [list(want(t)) for t in texts]


def test_one_tree_equals_many(references):
    m = references["ranks"][0].merges
    pieces = [p for p in (t.encode() for t in made(200, 5)) if 0 < len(p) <= bpe.WIDEST]
    assert m.encode(pieces) == [m._alone(p) for p in pieces]


def test_long_piece(references):
    encoder, want = references["ranks"]
    t = "ab" * 5000
    assert np.frombuffer(next(encoder.encode([t])), "<u2").tolist() == want(t)


def test_encode_decode(spark):
    texts = [None, "", *made(60, 4)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, RANKS).collect()}
    for i, t in enumerate(texts):
        assert bytes(got[i]["decoded"]).decode() == (t or "")
    assert bpe.encode_decode(df.limit(0), RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000) | st.integers(0, 2**64 - 1), max_size=700))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.uint64))
    bound = int(v[-1]) if len(v) else 0
    code = tokenfile.EliasFano.encode(v, bound)
    assert [code.select(i) for i in range(len(v))] == v.tolist()
    for i in range(0, len(v), 97):
        for n in (1, 5, 256, 400):
            n = min(n, len(v) - i)
            assert code.run(i, n).tolist() == v[i : i + n].tolist()
    assert tokenfile.EliasFano.sizes(len(v), bound, code.low_bits) == (len(code.samples) * 8, len(code.low), len(code.high))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.integers(1, 9)), max_size=600))
def test_shard(docs):
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
    ids = [np.arange(n, dtype="<u2").tobytes() for _, n in docs]
    raw = tokenfile.pack_shard([k for k, _ in docs], ids)
    s = tokenfile.Shard(raw)
    assert [s.key(i) for i in range(s.n)] == [k for k, _ in docs]
    assert [s.document(i).tobytes() for i in range(s.n)] == ids
    for i in range(0, s.n, 131):
        n = min(tokenfile.SAMPLE, s.n - i)
        keys, at = s.run(i, n)
        assert keys.to_pylist() == [k for k, _ in docs[i : i + n]] and [s.ids[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)] == ids[i : i + n]


def test_boundaries_take_little_room():
    ids = [bytes(2 * (300 + i % 50)) for i in range(2000)]
    beside = len(tokenfile.pack_shard(list(range(2000)), ids)) - sum(map(len, ids))
    assert beside * 8 / 2000 < 16  # bits a document, key included; plain tables take 128


def test_token_file(spark, tmp_path):
    texts = [(5, "b c"), (None, "a"), (-3, None), (5, "a a a"), (7, "word " * 50), (9, "")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, start int")
    shards = tokenfile.write(df, WORDS, shard_tokens=8)
    got = sorted(map(tuple, tokenfile.documents(shards).collect()), key=lambda r: r[1])
    lib, at = bpe.library(WORDS), 0
    for (k, t), row in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert row == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.export(shards, str(tmp_path / "out")) == shards.count() == len(list((tmp_path / "out").iterdir()))
    raw = next((tmp_path / "out").iterdir()).read_bytes()
    s = tokenfile.Shard(raw)
    assert s.document(s.n - 1)[-1] == 1
    assert tokenfile.documents(tokenfile.write(df.limit(0), WORDS)).count() == 0
    with pytest.raises(ValueError):
        tokenfile.Shard(b"x" * 64)


def check_packed(rows, docs, window):
    lib = bpe.library(BYTES)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for k, t in docs.items():
        ids, at = [*lib.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at <= window
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs), sum(n for p in seqs.values() for _, n in p)


def test_packing(spark):
    r = random.Random(1)
    docs = {i: " ".join(r.choice(["alpha", "beta", "of", "unheard"]) for _ in range(r.choice([3, 3, 3, 20, 40, 300]))) for i in range(120)} | {500: None, 501: ""}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, seq string")
    rows = packing.pack(df, BYTES, window=64).collect()
    n, tokens = check_packed(rows, docs, 64)
    assert n == -(-tokens // 64)  # only the last window is padded
    whole = packing.sequences(packing.pack(df, BYTES, window=64)).collect()
    assert sum(len(s["ids"]) for s in whole) == tokens and all(len(s["ids"]) <= 64 for s in whole)


def test_packing_of_nothing_and_of_copies(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, BYTES).count() == 0
    same = spark.createDataFrame([(i, "one two three") for i in range(200)], "doc_id long, text string")
    n, tokens = check_packed(packing.pack(same, BYTES, window=16).collect(), {i: "one two three" for i in range(200)}, 16)
    assert n == -(-tokens // 16)


def test_counts_use_no_length_too_often():
    r = np.random.default_rng(0)
    hist = np.bincount(np.clip(r.lognormal(6, 0.5, 5000).astype(int), 1, 1023), minlength=1024)
    hist[0] = 0
    combos = packing.combinations(hist, 1024)
    assert all(sum(c) == 1024 for c in combos)
    chosen = packing.whole_counts(hist, combos, packing.solve(hist, combos))
    used = np.zeros(1024, int)
    for c, n in chosen:
        for a in c:
            used[a] += n
    assert (used <= hist).all() and used.sum() > 0.5 * hist.sum()


def test_least_squares_are_solved():
    """By the conditions that only a best solution meets: no count below zero, no gradient below
    zero, and none but zero where the count isn't."""
    r = np.random.default_rng(2)
    hist = np.bincount(r.integers(1, 64, 3000), minlength=64)
    hist[0] = 0
    combos = packing.combinations(hist, 64, 8)
    x = packing.solve(hist, combos, 20000)
    a = np.zeros((64, len(combos)))
    for k, c in enumerate(combos):
        for n in c:
            a[n, k] += 1
    grad = a.T @ (a @ x - hist)
    assert (x >= 0).all() and grad.min() > -0.1 and np.abs(grad * x).max() < 1


MARKED = [*chat.MARKS, "\\", "[", "<", "x", "/", "INST]", " ", "s>", "日", "\n", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKED), max_size=8).map("".join))
def test_escape(text):
    inside = chat.escape(text)
    assert chat.unescape(inside) == text
    for m in chat.MARKS:
        assert sum((m + inside + m).count(x) for x in chat.MARKS) == 2


def test_chat(spark):
    turns = [(1, 0, "system", "be"), (1, 1, "user", chat.ODD), (1, 2, "assistant", chat.ODD), (1, 3, "assistant", ""), (2, 0, "tool", "[TEXT]\\"), (None, None, None, None), (2, 0, "tool", "[TEXT]\\")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, ids int").drop("ids")
    formatted = chat.format_turns(df, BYTES)
    lib = bpe.library(BYTES)
    for r in formatted.collect():
        role, text, under = chat.read(np.array(r["ids"]), np.array(r["mask"]), lambda i: lib.decode(i.tolist(), skip_special_tokens=False))
        assert (r["conv_id"], r["turn"], role or None, text or None) in [(c, t, o, x or None) for c, t, o, x in turns]
        assert under == (text if role == "assistant" else "")
        assert sum(i >= chat.RESERVED for i in r["ids"]) == (2 if role in chat.ROLES else 3) + (r["position"] == 0)
    got = {r["conv_id"]: r for r in chat.digests(formatted, BYTES).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"], got[None]["n_turns"]) == (4, len(chat.ODD), 2, 1)
    ends = {r["position"]: r["start"] + len(r["ids"]) for r in formatted.where("conv_id = 1").collect()}
    assert [r["start"] for r in formatted.where("conv_id = 1 and position > 0").orderBy("position").collect()] == [ends[i] for i in range(3)]
    assert chat.digests(chat.format_turns(df.limit(0), BYTES), BYTES).count() == 0


def test_long_conversations_are_spread(spark):
    """One conversation of most rows, over many tasks, rows that repeat among them: places are those of one task."""
    turns = [(7, i // 2, "user" if i % 2 else "assistant", f"turn {i % 50}") for i in range(3000)] + [(7, 4, "user", "same")] * 500 + [(None, i, "system", "x") for i in range(50)] + [(c, 0, "user", "y") for c in range(20, 60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(9)
    formatted = chat.format_turns(df, BYTES)
    got = {}
    for r in formatted.collect():
        got.setdefault(r["conv_id"], []).append((r["position"], r["start"], r["turn"], len(r["ids"]), r["ids"][0] == chat.RESERVED, r["formatted"]))
    for conv, rows in got.items():
        rows.sort()
        want = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1:])
        at = 0
        for i, (row, t) in enumerate(zip(rows, want, strict=True)):
            assert row[:3] == (i, at, t[1]) and row[4] == (i == 0) and t[3] in row[5]
            at += row[3]
    assert {r["conv_id"]: r["n_turns"] for r in chat.digests(formatted, BYTES).collect()} == {c: len(r) for c, r in got.items()}


def test_chat_query_equals_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    want = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in want.description]
    got = chat.op1_token_level_chat(spark, data).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
