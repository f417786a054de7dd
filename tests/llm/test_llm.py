import hashlib
import itertools
import math
import pathlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import brown_lm, chat_format, decontaminate, kd_search, ngram_join, packing, substring_dedup, texts, token_counts, token_files, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, block long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(seed: int = 1, n: int = 60) -> list[tuple]:
    """Groups of near copies, exact copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(300)] + ["é", "ß.", "x,"]

    def some(k):
        return [rng.choice(vocab) for _ in range(k)]

    passage, base, out = some(30), some(80), []
    for i in range(n):
        kind = i % 6
        w = some(rng.randrange(1, 60))
        if kind == 0:
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(80)] = rng.choice(vocab)
        elif kind == 1:
            w = w + passage + some(5)
        elif kind == 2:
            w = list(base[:40])
        out.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "one two"), (3, out[3][1]), (None, out[1][1]), (None, None), (n + 5, " ".join(some(6000)))]
    return [(i, t, None, None, None if t is None else len(t), 0.5, "k", 1) for i, t in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t, lower=True):
    return WORD.findall((t or "").translate(LOWER) if lower else t or "")


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_group(seed: int) -> list[tuple]:
    """One large group of near copies around the threshold, by words replaced, left out, put in and moved, with a variant that has copies of its own."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(70)]
    variant = base[:20] + [f"v{i}" for i in range(9)] + base[29:]
    out = []
    for i in range(260):
        w = list(variant if i % 5 == 4 else base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            at = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                w[at] = f"n{rng.randrange(5000)}"
            elif kind == 1:
                del w[at : at + rng.randrange(1, 6)]
            elif kind == 2:
                w.insert(at, f"n{rng.randrange(20)}")
            else:
                w = w[at:] + w[:at] if rng.random() < 0.2 else w[: max(40, len(w) - rng.randrange(12))]
        out.append((1000 - i, " ".join(w)))
    return [(i, t, None, None, len(t), 0.5, "k", 1) for i, t in out]


@pytest.mark.parametrize("k,percent,few,seed", [(4, 85, 64, 0), (5, 80, 2, 0), (3, 60, 1, 0), (4, 85, 1, 1), (4, 85, 16, 2), (5, 80, 1, 3), (2, 90, 4, 4)])
def test_jaccard_components(spark, k, percent, few, seed):
    rows = texts_of(k, 90) + (near_group(seed) if seed else [])
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = ngram_join.jaccard_components(frame(spark, rows), k, percent, few).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t, k)), find(i)) for i, t, *_ in rows if i is not None)
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2


@pytest.mark.parametrize("k,percent", [(4, 85), (3, 60)])
def test_all_jaccard_links(spark, k, percent):
    rows = texts_of(k, 90)
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            want.add((a, b))
    got = ngram_join.jaccard_links(frame(spark, rows), k, percent).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want)
    counts = ngram_join.link_counts(frame(spark, rows), k, percent).collect()
    assert sorted({(r.doc_id, r.n_links) for r in counts if r.doc_id is not None}) == [(i, sum(i in p for p in want)) for i in sorted(sets)]
    parts = ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in counts))) == sorted(map(str, map(tuple, parts)))
    assert len(want) > len({r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()})
    assert ngram_join.link_counts(frame(spark, [])).count() == 0


def family(m, seed=1):
    """100 near copies of one text and m of a variant of it; most do not link with each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    variant = base[:30] + [f"v{i}" for i in range(40)] + base[70:]
    out = []
    for i in range(100 + m):
        w = list(variant if i >= 100 else base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{rng.randrange(3000)}"
        out.append((i, " ".join(w), None, None, 0, 0.5, "k", 1))
    return out


def test_pairs_verified_grow_with_a_family_not_with_its_square(spark):
    from skein.session import Scratch

    for m in (300, 600, 1200):
        rows, scratch = family(m), Scratch(spark, "growth")
        _, classes, meet, sets = ngram_join._prepared(frame(spark, rows), 4, 85, scratch)
        links = ngram_join._links(meet, sets, 85, scratch, 64)
        if m == 300:
            node = {r.node: r["first"] for r in classes.collect()}
            found = [(node[r.a], node[r.b]) for r in links.collect()]
            words = [shingles(t, 4) for _, t, *_ in rows]
            want = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(words[a] & words[b]) >= 85 * len(words[a] | words[b])]
            assert _parts(found, len(rows)) == _parts(want, len(rows))
        names = ["pairs", *(f"{x}{i}" for x in ("around", "pairs") for i in range(ngram_join.LEVELS))]
        n = 0
        for name in names:
            try:
                n += spark.read.parquet(scratch.path(name)).count()
            except Exception:  # a level that was not reached
                continue
        assert n < 6 * len(rows) + 8 * links.count(), (m, n)  # with the group, and with the links there are


def _parts(edges, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_jaccard_of_an_empty_table(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window,block", [(13, 8 << 20), (6, 400)])
def test_substring_dedup(spark, window, block):
    rows = texts_of(7)
    seen = {}
    for i, t, *_ in rows:
        w = words(t, False)
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                seen[key] = min(i, seen.get(key, i))
    want = []
    for i, t, *_ in rows:
        w, gone = words(t, False), set()
        for j in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.repeated_spans(frame(spark, rows), window, block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert all(sum(s.after - s.first for s in r.spans) == r.n_removed for r in got) and any(r.n_removed for r in got)
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_decontamination(spark):
    rows = texts_of(9)
    rng = random.Random(4)
    items = [(i, " ".join(words(rows[j][1])[:20])) for i, j in enumerate((1, 7, 0, 13))] + [(9, None), (None, rows[1][1]), (10, "two words"), (1, " ".join(words(rows[7][1])[:20]))]
    items.append((11, " ".join(x if rng.random() < 0.97 else "zz" for x in words(rows[0][1]))))

    def five(t):
        return shingles(t, 5) if len(words(t)) >= 5 else set()

    want = set()
    for d, t, *_ in rows:
        for i, x in items:
            s = five(x)
            if d is not None and i is not None and s and 100 * len(s & five(t)) >= 80 * len(s):
                want.add((d, i, len(s & five(t)), len(s)))
    got = decontaminate.contained_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packing(spark):
    rows = texts_of(2)
    got = packing.packed_sequences(frame(spark, rows), "word_bpe_49k.json", 1, capacity=64, with_ids=True).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, *_ in rows)
    docs, bins = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in want)
    assert sum(r.length for r in got) > 0.9 * 64 * len(bins)
    assert sorted(bins) == list(range(len(bins)))
    assert packing.packed_sequences(frame(spark, []), "word_bpe_49k.json", 1).count() == 0


@pytest.mark.parametrize("n", range(0, 700, 37))
def test_cuts_fill_their_class(n):
    assert sum(packing.cuts(n, 128)) == n and all(128 // s * s > 128 - s for s in packing.cuts(n, 128))


def test_token_files_round_trip(spark, tmp_path):
    rows = texts_of(3)
    docs = frame(spark, rows)
    shards, index = str(tmp_path / "shards"), str(tmp_path / "index")
    token_files.write_shards(docs, shards, "byte_bpe_50k.json", 0, shard_ids=500)
    token_files.write_index(spark, shards, index, 5)
    got = token_files.fetch(token_files.numbered_keys(docs), shards, index, 5).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((str(i), start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((str(r.key), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    other = spark.createDataFrame([(k, 0) for k in range(10_000, 12_000)], "key long, occurrence long")
    assert token_files.lookup(other, index, 5).count() == 0 and token_files.fetch(other, shards, index, 5).count() == 0
    # a keyed fetch needs the files of its keys only
    few = spark.createDataFrame([(7, 0), (40, 0)], "key long, occurrence long")
    places = spark.read.parquet(f"{index}/manifest")
    hit = {r.path for r in token_files.lookup(few, index, 5).join(places, ["part", "shard"]).collect()}
    files = {r.path: pathlib.Path(urllib.parse.urlparse(r.path).path) for r in places.collect()}
    assert 1 <= len(hit) <= 2 < len(files)
    for place in files.keys() - hit:
        files[place].unlink()
    assert sorted((str(r.key), r.start, r.n_tokens, r.ids_crc32) for r in token_files.fetch(few, shards, index, 5).collect()) == sorted(w for w in want if w[0] in ("7", "40"))


def test_token_files_of_an_empty_table(spark, tmp_path):
    shards, index = str(tmp_path / "shards"), str(tmp_path / "index")
    token_files.write_shards(frame(spark, []), shards, "byte_bpe_50k.json", 0)
    token_files.write_index(spark, shards, index, 1)
    assert token_files.fetch(token_files.numbered_keys(frame(spark, [])), shards, index, 1).count() == 0


def test_perfect_hash_is_minimal():
    h = texts.mix(np.arange(5000, dtype=np.uint64))
    assert sorted(token_files.mphf_slots(token_files.build_mphf(h), h).tolist()) == list(range(5000))


def test_encoders_equal_the_libraries():
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(8)
    alphabet = list("aAbß éñ\n\n  \t'sté.,9,12<|▁ \r ́\x1c한字😀dON'T\x0b ") + [". ", ", ", "a. ", "a, ", " "] * 2
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(4000)] + ["<|endoftext|>", " <|endoftext|> a", "a\n", "", " ", "I'm we've", "a\n\nb"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = Tokenizer.from_file(tokens.vocabulary(name))
        ids, at = tokens.IdEncoder(name)(*texts.buffers(pa.array(some)))
        assert all(ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(some))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    assert [sum(x) for x in tokens.count_units("piece_bpe_32k.model")(some)] == [len(x) for x in sp.encode(some)]


def test_token_counts_encode_misses_once(spark, tmp_path):
    import sentencepiece

    rows, cache = texts_of(5), str(tmp_path / "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows)
    for n in (40, len(rows), len(rows)):
        part = rows[:n]
        got = token_counts.token_counts(frame(spark, part), "piece_bpe_32k.model", cache, 100).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == (want if n == len(rows) else sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in part))
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in part})


def test_kd_search_is_exact(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-6, 7, (300, 5)), np.tile([[3, 1, 0, -2, 5]], (150, 1)), np.zeros((50, 5), int)])
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(v)] + [(7, [int(x) for x in v[7]]), (900, [1, 2]), (901, [2, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = kd_search.top_k(df, df.where("vec_id % 20 = 0 or vec_id >= 900"), 5, shard_rows=100, query_rows=4)
    want = set()
    for q in [*range(0, 500, 20)]:
        s = sorted((-int(v[q] @ v[i]), i) for i in range(500) if i != q)[:5]
        want |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    want |= {(900, 1, 901, 6), (901, 1, 900, 6)}
    assert {tuple(r) for r in got.collect()} == want
    more = df.select("*", F.lit(1).alias("shard"), F.lit(2).alias("score"), F.lit(3).alias("home"))
    assert {tuple(r) for r in kd_search.top_k(more, more.where("vec_id % 20 = 0 or vec_id >= 900"), 5, shard_rows=100).collect()} == want
    assert kd_search.top_k(df.limit(0), df.limit(0)).count() == 0 and kd_search.top_k(df, df.limit(0)).count() == 0


def test_kd_tree_leaves_out_what_can_not_enter():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 8))
    v = np.concatenate([c + rng.integers(-5, 6, (100, 8)) for c in centres])
    tree = kd_search.Tree(np.arange(len(v)), v)
    q = v[::500]
    bar = np.sort(q @ v.T, axis=1)[:, -6]
    bounds = kd_search._bounds(q, bar, np.full(len(q), kd_search.NO_ID), tree, np.int64)
    assert (bounds == kd_search.NO_SCORE).any()  # subtrees that no query enters are not looked at
    leaves = tree.kids < 0
    assert (bounds[:, leaves] >= bar[:, None]).mean() < 0.25
    for node in np.flatnonzero(~leaves):
        for kid in (tree.kids[node], tree.kids[node] + 1):
            assert (tree.low[kid] >= tree.low[node]).all() and (tree.high[kid] <= tree.high[node]).all()


def test_kd_query_leaves_out_what_is_not_finite(spark, tmp_path):
    rows = [(0, [0.5, 1.0]), (50, [float("nan"), 1.0]), (1, [None, 1.0]), (2, None), (3, [-0.001, 1.0]), (None, [1.0, 1.0]), (4, [float("inf"), 0.0]), (100, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in kd_search.op1_kd_search(spark, str(tmp_path)).collect()}
    assert got == {(0, 1, 100, 98304), (0, 2, 3, 65408), (100, 1, 0, 98304), (100, 2, 3, 65280)}


def test_chat_round_trip():
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "]", " ", "<", "/s>", "a", "\n", "[ROLE]", "[TEXT]", "[/ROLE]", "[SYS]", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[ROLE]", "x\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(3)]
        assert chat_format.read_back("".join(chat_format.render_turn(*t) for t in turns)) == turns


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "[INST]"), (1, 1, "assistant", "b</s>")]
    got = {r.conv_id: r for r in chat_format.recovered(chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = "\n\nuser\na\nassistant\nb</s>\nassistant\nb</s>\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b</s>b</s>").hexdigest() and got[1].loss_chars == 10 and got[None].n_turns == 1


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6)) for _ in range(rng.randrange(2, 12))]
        bad = rng.random() < 0.3
        if bad:
            s[rng.randrange(len(s))] += " scumbag"
        rows.append((i, ". ".join(s), None, None, 1, 0.1, "k", 1))
        labels.append((i, int(bad)))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", None, None, 0, None, None, None), (None, "scumbag", None, None, 7, None, None, None)]
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (5, 1 - labels[5][1]), (6, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model, with_sentences=True).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].predicted == labels[i][1] for i in held) and len(held) > 50
    for i in held:
        text = rows[i][1]
        said = [n for n, x in enumerate(toxicity.sentences(text)) if "scumbag" in x]
        assert [x["number"] for x in got[i].sentences] == said
        assert all("scumbag" in text[x["start"] : x["end"]] and ". " not in text[x["start"] : x["end"]].strip() for x in got[i].sentences)
        # the noisy-or of the sentences, each scored from the model's weights alone
        clean = 1.0
        for x in re.split(r"[.!?\n]+", text):
            if x.split():
                z = model.bias + sum(model.weights.get(f, 0.0) for w in set(x.split()) for f in toxicity.word_features(w))
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(got[i].score - (1 - clean)) < 1e-9
    assert got[1000].score == 0.0 and got[1001].score == 0.0 and got[None].predicted == 1
    assert toxicity.fit([("a", 1)]).score("a") == 0.0
    none = toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity_scores(frame(spark, []), none).count() == 0
    # the bound counts ids, whatever the number of their rows or the length of a text
    many = spark.createDataFrame([(1, "x " * 1000, 0)] * 50 + [(i, f"word{i} scumbag", 1) for i in range(2, 40)], "doc_id long, text string, y int")
    few = toxicity.train(many.drop("y"), many.select("doc_id", F.col("y").alias("toxic")), max_training=30)
    assert few.bias is None or few.weights


def test_language_model(spark):
    rows = [(i, t) for i, t, *_ in texts_of(11)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    df = spark.createDataFrame([(i, t, h) for (i, t), h in zip(rows, held, strict=True)], "doc_id long, text string, held boolean").repartition(3)
    got = brown_lm.scores(df, n_base=6, share=0.002, rounds=3, block_bytes=6000).collect()
    from collections import Counter

    c = Counter()
    toks = [[*words(t), None] for _, t in rows]
    for w, h in zip(toks, held, strict=True):
        if not h:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), h, w in zip(rows, held, toks, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert brown_lm.scores(df.limit(0)).count() == 0


def test_language_model_scores_by_brute_force(spark):
    """With one class of words and one of ends, exchange has no choice, and every probability can be worked out by hand."""
    from collections import Counter

    rows = [(i, t) for i, t, *_ in texts_of(12)]
    held = [i is not None and i % 5 == 2 for i, _ in rows]
    df = spark.createDataFrame([(i, t, h) for (i, t), h in zip(rows, held, strict=True)], "doc_id long, text string, held boolean").repartition(3)
    toks = [[*words(t), None] for _, t in rows]
    c = Counter(x for w, h in zip(toks, held, strict=True) if not h for x in w)
    n, v, ends = sum(c.values()), len(c), c[None]
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    moves = Counter()  # kind of what precedes (word, end, rare for a word seen once) -> kind of the token
    for w, h in zip(toks, held, strict=True):
        if not h:
            for left, x in zip([None, *w], w, strict=False):
                moves["end" if left is None else "word", x is None] += 1
                moves["rare", x is None] += left is not None and c[left] == 1 or left is None and ends == 1

    def move(left, is_end):
        part = (ends if is_end else n - ends) / n
        return (moves[left, is_end] + 5 * part) / (moves[left, True] + moves[left, False] + 5)

    want = []
    for (i, _), w in zip(rows, toks, strict=True):
        total = 0.0
        for left, x in zip([None, *w], w, strict=False):
            kind = "end" if left is None else "word" if c[left] else "rare"
            if x is None:
                p = move(kind, True)
            elif c[x]:
                p = move(kind, False) * (c[x] - d) / (n - ends)
            else:
                p = move(kind, False) * d * (v - 1) / (n - ends)
            total += math.log10(0.95 * p + 0.05 * (c[x] + 1) / (n + v + 1))
        want.append((str(i), round(total, 6)))
    for share in (0.002, 0):
        got = brown_lm.scores(df, n_base=2, share=share, rounds=2, block_bytes=6000)
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in got.collect()) == sorted(want)


def test_model_sums_to_one():
    rng = np.random.default_rng(1)
    k = 5  # two exchange classes with the end's, two of other words, one without votes
    counts = [np.array([4, 2]), np.array([9]), np.array([1, 1, 3]), np.array([2]), np.array([1])]
    stats = np.concatenate([[8, 3, 2], [c.sum() for c in counts], [len(c) for c in counts]])
    m = brown_lm.Model(stats, rng.integers(0, 9, (k + 1, k)).astype(float), 2, 0.9)
    for context in range(k + 1):
        known = sum(m.move[context, j] * ((c - m.discount[j]) / m.size[j]).sum() for j, c in enumerate(counts))
        assert abs(known + m.unseen[context] - 1) < 1e-9


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    truth = np.arange(20) % 2
    right = np.zeros((20, 3))
    right[np.arange(20), 1 - truth] = 50
    classes = rng.integers(0, 2, 20)
    # contexts by their true class: words of one kind are followed by the other
    brown_lm.exchange_round(classes, np.arange(20), right, right.copy(), 2)
    assert len(set(classes[truth == 0])) == 1 and len(set(classes[truth == 1])) == 1 and classes[0] != classes[1]


def test_rare_words_are_clustered_by_both_contexts(spark):
    rows = [(100 + 4 * i + j, f"a r{i} {'xy'[i % 2]}", False) for i in range(40) for j in range(3)]
    rows += [(1, "a r0 x", True), (2, "a r0 y", True), (3, "a r7 y", True), (4, "a r7 x", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in brown_lm.scores(df, n_base=6, share=0.02, block_bytes=500).where("held_out").collect()}
    assert got[1] > got[2] + 0.5 and got[3] > got[4] + 0.5


def test_best_classes_against_the_likelihood():
    rng = np.random.default_rng(3)
    k, n = 5, 12
    now = rng.integers(0, k - 1, n)
    now[0], now[1] = k - 1, -1
    counts = rng.integers(0, 14, (n, 2, k))
    table = np.zeros((k, k))
    for side in (0, 1):  # every word's counts are in the table, for both of its sides
        for w in np.flatnonzero(now >= 0):
            if side == 0:
                table[now[w]] += counts[w, 0]
            else:
                table[:, now[w]] += counts[w, 1]
    key = np.flatnonzero(counts.ravel())
    got = brown_lm.best_classes(now, np.arange(n, dtype=np.uint64), key, counts.ravel()[key], table, k - 1)

    for w in range(1, n):
        rows, cols = table.copy(), table.copy()
        if now[w] >= 0:
            rows[now[w]] -= counts[w, 0]
            cols[:, now[w]] -= counts[w, 1]
        f = brown_lm._xlogx
        value = []
        for c in range(k - 1):
            x, y = rows.copy(), cols.copy()
            x[c] += counts[w, 0]
            y[:, c] += counts[w, 1]
            value.append(f(x).sum() - f(x.sum(1)).sum() + f(y).sum() - f(y.sum(0)).sum())
        assert value[got[w]] >= max(value) - 1e-6
    assert got[0] == k - 1


def test_classes_follow_the_vocabulary():
    assert [brown_lm.class_number(n) for n in (0, 10_000, 86_461, 404_216)] == [48, 48, 90, 148]


def test_queries_and_sql_have_the_same_names():
    from skein.llm import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows = texts_of(13, 36)
    rows.append((70, "filler " * 3 + " ".join(f"B{i}" for i in range(20)) + " more words", None, None, 1, 0.5, "k", 1))
    bad = [i for i in range(200, 240)]
    rows += [(i, f"plain start{i}. you scumbag of q{i} z{i} r{i}", None, None, 1, 0.5, "k", 1) for i in bad]
    labelled = [i for i in bad if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(labelled) < len(bad)
    spark.createDataFrame([(i, 0) for i in range(36)] + [(i, 1) for i in labelled], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOCS)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        kept[name] = sorted(str(r.doc_id) for r in docs.collect())
    assert not {str(i) for i in bad} & set(kept["toxicity"])
    clean = [r for r in rows if r[0] not in bad]
    rows = [r for r in clean if str(r[0]) in kept["toxicity"]]
    assert len(rows) >= len(clean) - 2 and kept["toxicity"] == sorted(str(r[0]) for r in rows)
    # groups of near copies by all pairs of documents; rows of an id are one document
    sets, root = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, 5))
            root[i] = i
    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = root[a], root[b]
            root = {i: min(p, q) if r in (p, q) else r for i, r in root.items()}
    assert kept["near_duplicates"] == sorted([str(i) for i, r in root.items() if i == r] + ["None"] * 2)
    assert set(kept["repeated_passages"]) - set(kept["decontamination"]) == {"70"}
    # the packed pieces tile each document that was kept, and each sequence without gap
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect() if r.doc_id is not None}
    sequences, documents = {}, {}
    for r in P.packing(spark, docs, str(tmp_path)).collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            documents.setdefault(r.doc_id, []).append((r.start, r.length))
            assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert documents.keys() == want.keys()
    for doc, pieces in documents.items():
        assert [x for start, length in sorted(pieces) for x in range(start, start + length)] == list(range(len(want[doc])))
    assert sum(length for pieces in sequences.values() for _, length in pieces) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert P.run(spark, str(tmp_path)).count() == sum(map(len, sequences.values()))
