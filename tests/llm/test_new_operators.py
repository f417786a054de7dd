"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import fill_middle, prefix_trie, tokens, vector_packing
from skein.llm.vector_packing import Capacities, best_fit, vector_packed

DOCS = "doc_id long, text string, size int, part string"


def _one_by_one(sizes, room, score):
    """Best fit piece by piece: the sequences' pieces."""
    share = np.array(room.weights) / room.full.astype(float) ** 2
    left, out = [], []
    for s in sorted(sizes, reverse=True):
        v = room.vector(s)
        open_ = [i for i, r in enumerate(left) if (r >= v).all()]
        if open_:
            scores = vector_packing.SCORES[score](v, np.array([left[i] for i in open_]), share)
            i = open_[int(np.argmin(scores))]
        else:
            left.append(room.full)
            out.append([])
            i = len(left) - 1
        left[i] = left[i] - v
        out[i].append(s)
    return out


@pytest.mark.parametrize("score", ["dot", "norm"])
@pytest.mark.parametrize("room", [Capacities(64, 64, 64 * 64), Capacities(64, 4, 64 * 64), Capacities(64, 9, 1200), Capacities(50, 5, 900, (1.0, 3.0, 0.5))])
def test_the_plan_is_best_fit_piece_by_piece(room, score):
    rng = random.Random(7)
    for _ in range(12):
        sizes = [rng.choice([rng.randint(1, room.longest), rng.randint(1, 9), room.longest // 2]) for _ in range(rng.randint(1, 150))]
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        runs, n = best_fit(dict(counts), room, score)
        got, offsets = defaultdict(list), defaultdict(list)
        for j, (size, rank, first, each, at) in enumerate(runs):
            more = min((r[1] for r in runs[j + 1 :] if r[0] == size), default=counts[size])
            for k in range(more - rank):
                got[first + k // each].append(size)
                offsets[first + k // each].append(at + k % each * size)
        expected = _one_by_one(sizes, room, score)
        assert [got[i] for i in range(n)] == expected and len(got) == n
        for i in range(n):
            assert offsets[i] == [sum(got[i][:j]) for j in range(len(got[i]))]


def test_a_plan_of_very_many_pieces_is_short():
    rng = random.Random(3)
    counts = {s: rng.randint(1, 10**10) for s in range(1, 1025)}
    runs, n = best_fit(counts, Capacities(), "norm")
    assert len(runs) < 20_000
    assert n <= 1.01 * -(-sum(s * c for s, c in counts.items()) // 1024)


def test_a_piece_that_fits_nowhere_is_an_error():
    with pytest.raises(ValueError, match="fits no sequence"):
        best_fit({65: 1}, Capacities(64), "dot")


def test_vector_packing_of_all_kinds_of_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "word " * 3000, "a b c", "a b c", *("".join(rng.choice("abc dé.\n") for _ in range(rng.randint(1, 4000))) for _ in range(60))]
    rows = [(i // 2 if i % 7 else None, t, i, "x") for i, t in enumerate(texts)]
    for room in (Capacities(), Capacities(128, 6, 9000)):
        out = [r.asDict() for r in vector_packed(spark.createDataFrame(rows, DOCS).repartition(3), "byte_bpe_50k.json", 2, room, with_ids=True).collect()]
        docs, bins = defaultdict(list), defaultdict(list)
        for r in out:
            ids = np.frombuffer(r["ids"], "<u4")
            assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
            docs[r["doc_id"]].append(r)
            bins[r["sequence_id"]].append(r)
        for pieces in bins.values():
            pieces.sort(key=lambda r: r["offset"])
            assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
            assert sum(p["length"] for p in pieces) <= room.tokens and len(pieces) <= room.documents and sum(p["length"] ** 2 for p in pieces) <= room.attention
        tok = tokens.encoder("byte_bpe_50k.json").tok
        expected = sorted((i if i is not None else -1, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t, _, _ in rows)
        got = []
        for doc, pieces in docs.items():
            pieces.sort(key=lambda r: (r["piece"], r["start"]))
            firsts = [p for p in pieces if p["piece"] == 0]
            assert len(firsts) == sum(1 for r in rows if r[0] == doc)
            if len(firsts) == 1:
                ids = tuple(np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist())
                assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
                assert all(p["length"] == room.longest for p in pieces[1:])
                got.append((doc if doc is not None else -1, ids))
        for doc, ids in got:
            assert (doc, ids) in expected
        assert sum(r["length"] for r in out) == sum(len(ids) for _, ids in expected)
        lower = -(-sum(r["length"] for r in out) // room.tokens)
        assert len(bins) >= lower
    assert vector_packed(spark.createDataFrame([], DOCS), "byte_bpe_50k.json", 2).count() == 0


def _fim(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    return (n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle_is_exact_for_every_kind_of_text(spark):
    rng = random.Random(11)
    alphabet = ["a", "Z", "é", "\x01", "\x02", "0", "1", "\n", " ", "😀", "<", "P", "S", "M", ">", "\\", "$", " ", "\x00"]
    texts = [None, "", "\x01", "\x02\x01\x020", "<P>", "a<M>b", "x" * 100_000, "é " * 30_000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    rows = [(None if i % 50 == 3 else i // 2, t, i, "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    out = fill_middle.transformed(df)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix"] or "", r["middle"] or "", r["output"]) for r in out.collect())
    assert got == sorted((str(d), n, form, pre or "", mid or "", o) for d, t, *_ in rows for n, form, pre, mid, o in [_fim(d, t)])
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(d), t or "") for d, t, *_ in rows)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(spark.createDataFrame([], DOCS)).count() == 0


def _trie(rows, graft):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, role or "", text or ""))
    whole = {}
    for conv, said in turns.items():
        said.sort(key=lambda x: x[:2])
    for conv, said in turns.items():
        b, h = graft(conv)
        whole[conv] = [x[2:] for x in [*sorted(turns.get(b, []), key=lambda x: x[:2])[:h], *said[h:]]]
    # nodes by number, children before sums, as paths may be long
    nodes, child = [{"depth": 0, "last": "", "up": None, "members": [], "ends": [], "kids": 0}], {}
    for conv in sorted(whole):
        at = 0
        nodes[0]["members"].append(conv)
        for turn in whole[conv]:
            key = (at, turn)
            if key not in child:
                child[key] = len(nodes)
                nodes[at]["kids"] += 1
                nodes.append({"depth": nodes[at]["depth"] + 1, "last": turn[1], "up": at, "members": [], "ends": [], "kids": 0})
            at = child[key]
            nodes[at]["members"].append(conv)
        nodes[at]["ends"].append(conv)
    for x in reversed(nodes):
        x["saved"] = x.get("saved", 0) + (len(x["members"]) - 1) * len(x["last"])
        x["leaves"] = x.get("leaves", 0) + (x["kids"] == 0)
        if x["up"] is not None:
            up = nodes[x["up"]]
            up["saved"], up["leaves"] = up.get("saved", 0) + x["saved"], up.get("leaves", 0) + x["leaves"]
    return sorted(
        (x["members"][0], x["depth"], -1 if x["up"] is None else nodes[x["up"]]["members"][0], len(x["members"]), x["kids"], x["leaves"], x["saved"], hashlib.sha256(",".join(map(str, x["ends"])).encode()).hexdigest())
        for x in nodes
    )


TURNS = "conv_id long, turn long, role string, text string, depth int, parent_conv_id string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _got(trie):
    return sorted(tuple(-1 if v is None else v for v in (r[c] for c in FIELDS)) for r in trie.collect())


def _conversations():
    rng = random.Random(2)
    rows = []
    for c in range(240):
        shared = rng.randint(0, 6)
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"hi {t}" if t < shared else rng.choice([None, "", "ok", f"é{rng.randint(0, 5)}"]), 1, "x"))
    rows += [(300 + i, t, "user", "same", 1, "x") for i in range(40) for t in range(3)]  # exact copies
    rows += [(c, None, "user", "null turn", 1, "x") for c in (5, 301)] + [(5, 2, "user", "tie", 1, "x"), (5, 2, "user", "tie", 1, "x"), (None, 1, "user", "no id", 1, "x"), (-3, 0, "user", "hi 0", 1, "x")]
    return rows


def test_prefix_trie_against_brute_force(spark):
    rows = _conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    crc = lambda c: zlib.crc32(str(c).encode()) % 6
    assert _got(prefix_trie.prefix_trie(df)) == _trie(rows, lambda c: (None, 0))
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    got = prefix_trie.prefix_trie(df, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, fan=2)
    assert _got(got) == _trie(rows, lambda c: (base(c), crc(c)))


def test_prefix_trie_of_long_and_nested_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 64)
    long = [(7, t, "user", f"turn {t % 50}", 1, "x") for t in range(25_000)]
    # each of these leaves the long one somewhere, or the one before it
    nested = [(c, t, "user", f"turn {t % 50}" if t < 3 * c else f"own {c}", 1, "x") for c in range(8, 40) for t in range(3 * c + 2)]
    stopped = [(c, t, "user", f"turn {t % 50}", 1, "x") for c in range(50, 60) for t in range(10 * (c - 49))]
    rows = long + nested + stopped
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    assert _got(prefix_trie.prefix_trie(df)) == _trie(rows, lambda c: (None, 0))


def test_a_chain_of_paths_is_summed_in_few_rounds(spark):
    # conversation c leaves c - 1 at its last turn but one: the tree of paths is as deep as there are conversations
    rows = [(c, t, "user", f"{min(t, c)}", 1, "x") for c in range(60) for t in range(c + 2)]
    assert _got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == _trie(rows, lambda c: (None, 0))


def test_prefix_trie_of_nothing_and_of_empty_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # all of 101's turns are replaced by those of a conversation that is not there
    rows = [(101, 0, "user", "a", 1, "x"), (102, 0, "user", "b", 1, "x")]
    got = _got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), lambda c: c - 50, lambda c: F.lit(3)))
    assert got == _trie(rows, lambda c: (c - 50, 3)) and len(got) == 1


def test_nodes_have_their_last_turn(spark):
    rows = _conversations()
    df = spark.createDataFrame(rows, TURNS)
    found = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.last_turns(prefix_trie.prefix_trie(df), df).collect()}
    assert len(found) == len(_trie(rows, lambda c: (None, 0)))
    for conv, depth in [(300, 1), (300, 3)]:
        assert found[conv, depth] == ("user", "same")
    assert all((v == (None, None)) == (k[1] == 0) for k, v in found.items())
