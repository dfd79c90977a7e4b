"""Merge-type pieces, the prefix trie and the filter audit, against the library and against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import pytest

from graphloom.llm import common, filter_audit, piece_bpe, prefix_trie, queries
from graphloom.llm.encoders import read_vocabulary
from test_operators import AWKWARD, SF, table

P = pytest.importorskip("public_tokenizers")
EMPTY = hashlib.sha256(b"").hexdigest()


# 11: sentencepiece


def pieces_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pieces_are_the_librarys():
    encoder, library, rng = piece_bpe.MergeEncoder(read_vocabulary(P.path("piece_bpe_32k.model"))), pieces_library(), random.Random(3)
    odd = ["", " ", "  a", "a  ", "\n", " \n \n", "▁▁a ▁ b", "a▁b", "aaaab" * 999, " " * 999 + "x", "日本語テキスト 🙂 é̀", "<s> </s> <0x0A>", "a\x00b\r\t", "ababab " * 50]
    odd += ["".join(rng.choice("ab  \n▁eth,in.ing\t日é") for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for text in odd:
        ids = encoder.encode(text)
        assert ids == library.encode(text), text
        assert encoder.decode(ids) == library.decode(ids)
        joined = [x for found, _ in encoder.units(text) for x in found]
        assert joined == ids


def test_pieces_go_back_from_dead_ends():
    """The longest match is not always the encoding, and shared places are not tried twice."""
    encoder = piece_bpe.MergeEncoder(read_vocabulary(P.path("piece_bpe_32k.model")))
    pieces = sorted(x for x in encoder.ids if 3 < len(x) < 9)
    rng, shorter = random.Random(1), 0
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(4))
        found = encoder._pieces(text)
        assert found == encoder._merge(text)
        shorter += any(text[at : at + len(x) + 1] in encoder.ids for at, x in zip(itertools.accumulate([0, *map(len, found)]), found))
    assert shorter > 20


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_piece_documents(spark, which):
    docs = table(spark, AWKWARD) if which == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    library, got = pieces_library(), piece_bpe.encode_documents(docs, P.path("piece_bpe_32k.model"))
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    rows = got.collect()
    key = repr
    assert sorted((tuple(r[:4]) for r in rows), key=key) == sorted(expected, key=key)
    again = piece_bpe.decode_documents(got.select("doc_id", "ids"), P.path("piece_bpe_32k.model")).collect()
    assert sorted((tuple(r) for r in again), key=key) == sorted(((r.doc_id, r.decoded) for r in rows), key=key)


def test_piece_of_empty_and_very_long(spark):
    empty = table(spark, [])
    assert piece_bpe.encode_documents(empty, P.path("piece_bpe_32k.model")).collect() == []
    long = [(1, "x" * 300_000 + " " * 100_000, "s"), (2, "lorem ipsum, " * 60_000, "s"), (3, "日本" * 100_000, "s")]
    got = {r.doc_id: r for r in piece_bpe.encode_documents(table(spark, long), P.path("piece_bpe_32k.model")).collect()}
    for k, text, _ in long:
        assert got[k].ids == pieces_library().encode(text) and got[k].decoded == text


# 12: the prefix trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    digest = {p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest() for p in members}
    rows = [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest[p]) for p, m in members.items()]
    return sorted(rows, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, shard string, digest string, n string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CONVERSATIONS)


def trie(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.rebuilt_trie(conversations(spark, rows)).collect()), key=repr)


def odd_conversations():
    rng, rows = random.Random(5), []
    for c in [*range(0, 40), 100, 107, 250, 251, 399, -5, -100, -101, 10**12]:
        for turn in range(rng.randrange(0, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "", None, "naïve 🙂", "x" * 5000, "0:x"])))
    rows += [(5, None, "system", "first"), (5, 3, "user", "tie a"), (5, 3, "user", "tie b"), (5, 3, "user", "tie b"), (None, 1, "user", "nobody"), (300, 0, "user", "hi"), (300, 0, "user", "hi")]
    rng.shuffle(rows)
    return rows


def test_trie(spark):
    rows = odd_conversations()
    assert trie(spark, rows) == brute_trie(rows)
    assert any(r[1] == 0 and r[3] > 40 for r in trie(spark, rows))


def test_trie_of_hot_turns_and_long_conversations(spark, monkeypatch):
    """One conversation over many shards, one first turn that all share, ends that many share; every key in place."""
    rng = random.Random(8)
    rows = [(200, t, "user", f"turn {t}") for t in range(150)]
    for c in range(201, 330):
        rows += [(c, 0, "user", "good morning"), *((c, t, "assistant", rng.choice(["yes", "no"])) for t in range(1, rng.choice([1, 1, 6, 9])))]
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    assert trie(spark, []) == trie(spark, [(None, 0, "user", "x")]) == []
    # 8 takes five turns of a base that isn't there, and has none after its first five: a member of the root alone
    assert zlib.crc32(b"8") % 6 == 5
    assert trie(spark, [(8, 0, "user", "x")]) == [(8, 0, None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())]


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "c long, k long, v long").where("c is not null")
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.running_sums(df, "c", [F.col("k")], {"s": F.col("v")}, common.Scratch(spark, "sums"), "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.shard for r in got if r.c == 1}) > 1
    held = collections.Counter()
    expected = {}
    for c, k, v in sorted(r for r in rows if r[0]):
        held[c] += v
        expected[c, k] = held[c]
    assert {(r.c, r.k): r.s for r in got} == expected


# 13: the filter audit


def brute_audit(docs, labels):
    import re

    first, rows = {}, []
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    marks = {m: {i for i, *values in labels if i is not None and values[k] == 1} for k, m in enumerate(("good", "toxic"))}
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id}
        rows.append((source or "", {f for f, bad in fails.items() if bad}, doc_id in marks["good"], doc_id in marks["toxic"]))
    out = []
    for part in {r[0] for r in rows}:
        own, total, steps = [r for r in rows if r[0] == part], collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                total[f] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def audit(spark, docs, labels):
    marked = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(tuple(r) for r in filter_audit.audit(table(spark, docs), marked).collect())


def audited():
    prose = " ".join(f"word{k}" for k in range(250))
    docs = [*AWKWARD, (20, prose, "s0"), (21, prose, "s0"), (21, prose, "s5"), (22, prose + " A#", "s1"), (23, prose.upper(), None), (24, "same word " * 300, ""), (None, prose, "s0"), (25, "$ " * 400, "s0"), (2, "", "s9"), (26, "é" * 97 + "ABC", "s9"), (27, "é" * 98 + "AB", "s9")]
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (22, 1, 1), (None, 1, 1), (25, None, 1), (9, 1, 0), (999, 1, 1), (1, 1, None), (2, 2, 1)]
    return docs, labels


@pytest.mark.parametrize("index_rows,hot", [(1 << 20, 20_000), (3, 2)])
def test_audit(spark, monkeypatch, index_rows, hot):
    monkeypatch.setattr(filter_audit, "INDEX_ROWS", index_rows)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    docs, labels = audited()
    assert audit(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_nothing_and_long_texts(spark, monkeypatch):
    assert audit(spark, [], [(1, 1, 1)]) == []
    monkeypatch.setattr(filter_audit, "_LONG", 40)
    docs = [*audited()[0], (50, "many words here " * 30_000, "s0")]
    assert audit(spark, docs, []) == brute_audit(docs, [])


def test_bitmaps_of_any_filters(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c" * 50]), *(rng.choice([True, False, None]) for _ in range(4))) for _ in range(500)]
    df = spark.createDataFrame(rows, "p string, x boolean, y boolean, z boolean, m boolean").repartition(7)
    got = filter_audit.subset_counts(filter_audit.bitmap_index(df, ["x", "y", "z"], "p", ["m"]), 3, ["m"]).collect()
    expected = {}
    for part in {r[0] or "" for r in rows}:
        for subset in range(8):
            left = [r for r in rows if (r[0] or "") == part and not any(r[1 + k] for k in range(3) if subset >> k & 1)]
            expected[part, subset] = (len(left), sum(bool(r[4]) for r in left))
    assert {(r.part, r.subset): (r.n, r.m) for r in got} == expected
    with pytest.raises(ValueError):
        filter_audit.subset_counts(df, 11)


def test_registered_queries_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in queries.queries()["op13_filter_audit"](spark, SF).collect()) == brute_audit(docs, labels)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.queries()["op12_prefix_trie"](spark, SF).collect()), key=repr) == brute_trie(rows)
    library = pieces_library()
    got = {r.doc_id: r.ids_sha256 for r in queries.queries()["op11_piece_bpe"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest() for i, t, _ in docs}
