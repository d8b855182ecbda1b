import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import embedding_dedup, exact_dedup, langid, minhash_dedup, mixing, packing, shards, suffix_dedup, tokens, url_filter, warc
from quillstream.llm.common import hot_join, shared_dir

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en" if t else None, None if i == 1 else "src1", None, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC)


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


TEXTS = [None, "", "A", prose(300, 1), prose(300, 1), prose(300, 1).upper(), prose(290, 1) + " " + prose(10, 2), prose(5, 3), "12 34", prose(6000, 4)]


def test_suffix_dedup_equals_brute_force(spark):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, TEXTS)).collect()}
    seen = {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        assert tuple(got[i])[1:] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 300, 20_000])
def test_multikey_quicksort_sorts(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 40, (n, 3)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(x, 2)
    assert sorted(order.tolist()) == list(range(n))
    rows = [tuple(r) for r in x[order][:, :2].tolist()]
    assert rows == sorted(rows)


def test_hot_passages_equal_brute_force(spark):
    """Passages in every block with different surroundings, copies, and periodic texts."""
    rng = np.random.default_rng(8)
    hot, other = prose(30, 70), prose(25, 71)
    texts = [prose(int(rng.integers(1, 60)), 2000 + i) + (" " + hot) * (i % 3) + prose(int(rng.integers(0, 9)), 3000 + i) + (other if i % 2 else "") for i in range(150)]
    texts += ["ab" * 200, "ab" * 90 + "c", "é" * 300, "é" * 25, texts[0], texts[1][3:], hot, hot[:49], hot[:50]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert got[i] == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())


def test_deep_shallow_sorts():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 99, (400, 50)).astype(np.uint8)
    x[:, :40] = 97
    order, group = suffix_dedup.deep_shallow(x)
    rows = [x[i].tobytes() for i in order]
    assert rows == sorted(rows)
    assert all((a == b) == (rows[i] == rows[i + 1]) for i, (a, b) in enumerate(zip(group, group[1:])))


def test_near_dedup_links(spark):
    got = {r.doc_id: r for r in minhash_dedup.near_dedup(docs(spark, TEXTS), shingle=4).collect()}
    assert [got[i].component_id for i in (3, 4, 5, 6)] == [3, 3, 3, 3]
    assert got[0].n_shingles == 0 and got[2].n_shingles == 1 and got[9].kept
    assert minhash_dedup.near_dedup(docs(spark, [])).count() == 0


def families(seed, n=40):
    """Texts with copies, near copies on both sides of the threshold, shared passages and repeated words."""
    rng, out = np.random.default_rng(seed), [None, "", " \t", "one", "One two", "a b c", "A B C D", "x " * 400]
    shared = prose(120, 999)
    for k in range(n):
        words = prose(int(rng.integers(4, 220)), 1000 + k).split()
        out.append(" ".join(words))
        for share in (0.0, 0.01, 0.03, 0.05, 0.08, 0.15):
            near = [w if rng.random() >= share else "zz" + w for w in words]
            out.append((" ".join(near).upper() if share == 0.01 else "\n ".join(near)) + (" tail" if share == 0.05 else ""))
        if k % 4 == 0:
            out.append(shared + " " + " ".join(words[: int(rng.integers(1, 60))]))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_equals_brute_force(spark, k):
    texts = families(3)
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    done = False
    while not done:
        done = True
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    done = False
    got = {r.doc_id: tuple(r)[1:] for r in minhash_dedup.near_dedup(docs(spark, texts), shingle=k, tile=16).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_near_dedup_with_null_and_repeated_ids(spark):
    rows = docs(spark, [prose(50, 1), prose(50, 1), prose(50, 2), prose(50, 2)], [5, None, 5, 7])
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_dedup(rows).collect())
    assert got == [(0, 0, False), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, TEXTS), buffer_bytes=1000).collect()}
    assert got[3].keep_id == 5 and got[5].kept and not got[3].kept and got[0].group_size == 2 and got[1].kept
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_patricia_holds_all_strings():
    root, words = exact_dedup.Patricia(), [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab"]
    for i, w in enumerate(words):
        root.insert(w)[0].add(i, i, 1)
    found = {w: (t.low, t.high, t.n) for w, t in root.terminals()}
    assert found[b"ab"] == (2, 6, 2) and set(found) == set(words) and root.held == sum(len(x) for x in (b"a", b"b", b"c", b"d", b"b"))


def test_language_codes(spark):
    code = langid.codewords(4)
    assert code.shape == (4, 7) and len({tuple(c) for c in code.T}) == 7
    got = {r.doc_id: r for r in langid.identify(docs(spark, TEXTS)).collect()}
    assert got[0].lang_pred == "und" and got[8].lang_pred == "und" and got[3].lang_pred == "en"


def test_mixing_spends_the_budget(spark):
    rows = mixing.mix(docs(spark, TEXTS), tenths=5, epochs=1).collect()
    assert sum(r.tokens_taken for r in rows) == sum(r.n_tokens for r in rows) * 5 // 10 and len(rows) == len(TEXTS)


def test_packing_is_gapless_and_whole(spark):
    texts = [*TEXTS, *ODD]
    rows = packing.pack(docs(spark, texts), per_block=3, capacity=300).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for got in by.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 300
    want = {(i, k): (s, len(x[s : s + 300]), zlib.crc32(x[s : s + 300].tobytes())) for i, x in enumerate(ids_of(texts)) for k, s in enumerate(range(0, len(x), 300))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert packing.pack(docs(spark, [])).count() == 0


def triplets(n, seed, capacity=1000):
    """Sizes that fill n bins of three each exactly, in random order."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers((capacity - a) // 2 - 60, (capacity - a) // 2 + 60))
        out += [a, b, capacity - a - b]
    return [int(x) for x in rng.permutation(out)]


def test_islands_beat_best_fit_decreasing():
    import random

    won = 0
    for seed in range(6):
        size = triplets(20, seed)
        down = sorted(range(60), key=lambda i: -size[i])
        plain = packing.best_fit(packing.Packing([], []), down, size, 1000)
        land = packing.epoch(size, 1000, [], random.Random(seed), 6, 300, 20)
        for p in land:
            assert sorted(i for b in p.bins for i in b) == list(range(60)) and max(p.loads) <= 1000
            assert packing.decoded(p.coded(60), size).fitness == p.fitness
        assert len(land[0].bins) <= len(plain.bins)
        won += len(land[0].bins) < len(plain.bins)
    assert won


def test_packing_evolves_and_migrates(spark):
    size = triplets(20, 3, 1000)
    texts = [" ".join(["a"] * (n - 1)) for n in size]
    down = sorted(range(60), key=lambda i: -size[i])
    plain = len(packing.best_fit(packing.Packing([], []), down, size, 1000).bins)
    rows = packing.pack(docs(spark, texts), capacity=1000, islands=3, people=5, epochs=2, generations=120).collect()
    assert len({r.sequence_id for r in rows}) < plain and len(rows) == 60


def test_packing_beats_best_fit_as_it_is_called():
    import inspect
    import random

    given = {k: v.default for k, v in inspect.signature(packing.pack).parameters.items()}
    for seed in range(8):
        size, least = triplets(20, seed), []
        down = sorted(range(60), key=lambda i: -size[i])
        for island in range(given["islands"]):
            land = []
            for e in range(given["epochs"]):
                land = packing.epoch(size, 1000, land, random.Random(f"{seed}:{island}:{e}"), given["people"], given["generations"], 20)
            least.append(len(land[0].bins))
        assert min(least) < len(packing.best_fit(packing.Packing([], []), down, size, 1000).bins)


def test_paired_sizes_meet_across_blocks(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["a"] * (n - 1)) for n in rng.permutation([11] * 300 + [9] * 300).tolist()]
    rows = packing.pack(docs(spark, texts), capacity=20, per_block=60).collect()
    assert len(rows) == 600 and len({r.sequence_id for r in rows}) <= 306


def test_feistel_is_a_permutation():
    for n in (1, 2, 5, 100, 1000):
        assert sorted(shards.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def ids_of(texts, end=0):
    """The tokenizer's ids of whole texts, each with the end id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


ODD = ["a.b. C, d.. e,", "\u03a3\u0391\u03a3 \u0130x", "e\u0301 \u0301e", "x<|endoftext|>y <|", "a\x1cb\x1f c", "\u00a0a\u3000b\u200bc\x85d", "'s it's 12.5, 3.", "\U0001f600 \u4e2d\u6587. ", "\x00. a_. b"]


def test_encoder_equals_the_tokenizer_on_whole_texts():
    enc = tokens.Encoder(tokens.tokenizer_path(), most=5)
    texts = [*TEXTS, *ODD, *(a + b for a in ODD for b in ODD)]
    for _ in range(2):
        ids, sizes = enc.encode(pa.array(texts))
        for got, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), ids_of(texts)):
            assert got.tolist() == want[:-1].tolist()


def test_full_table_keeps_chunks_that_came_up_again(monkeypatch):
    enc, learnt = tokens.Encoder(tokens.tokenizer_path(), most=30), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda fresh: (learnt.append(fresh.to_pylist()), learn(fresh))[1])
    often = "alfa beta*** gamma, d\u00e9lta. 555-12 "
    for k in range(12):
        texts = [often + " ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(9)), "\u0434\u0430 \u2c65x \u4e2d" if k % 3 else "It's Ok"]
        ids, sizes = enc.encode(pa.array(texts))
        for got, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), ids_of(texts)):
            assert got.tolist() == want[:-1].tolist()
        assert len(enc.known) <= 30 + 20
    assert sum("alfa" in x for x in learnt) == 1 and sum("555-12" in x for x in learnt) == 1


def test_words_that_skip_the_normalizer_keep_their_ids():
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.words and enc.chunks
    texts = ["stra\u00dfe \u00f1and\u00fa \u03c3\u03bf\u03c6\u03cc\u03c2 \u0434\u0430", "foo### 'tis don't x's 1st 555-4354 !!", "\u0374a \u0149b \u01c5c \u0390", "a\u00adb caf\u00e9\u00e9"]
    ids, sizes = enc.encode(pa.array(texts))
    for got, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), ids_of(texts)):
        assert got.tolist() == want[:-1].tolist()


def test_shards_read_back(spark):
    path, texts = shared_dir(spark, "t"), [*TEXTS, *ODD]
    n = shards.write_shards(docs(spark, texts), path, per_shard=4, stride=100)
    rows = shards.read_shards(spark, path).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    want = {(i, k): (len(x[s : s + 100]), zlib.crc32(x[s : s + 100].tobytes())) for i, x in enumerate(ids_of(texts)) for k, s in enumerate(range(0, len(x), 100))}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in rows} == want
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // 4, r.slot % 4 * 200)
    assert shards.read_shards(spark, path, from_slot=5).count() == n - 5
    assert shards.write_shards(docs(spark, []), shared_dir(spark, "t")) == 0


def test_shards_refuse_ids_that_do_not_fit():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["zebra crossing"]})
    from unittest.mock import patch

    with patch.object(shards.TaskContext, "get") as get, pytest.raises(ValueError):
        get.return_value.partitionId.return_value = 0
        list(shards._sequences(tokens.tokenizer_path(), 10, 1)([batch]))


def test_url_rules(spark):
    urls = [None, "x", "http://A.Example.com/en/7x?q", "http://example.com/en/8", "http://m.example.net/de/8#a", "http://q.net/de/", "http://com/en", "http://notnet/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(None, "allow"), (None, "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow")]
    for limit in (1 << 20, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.RULES, broadcast_bytes=limit).collect()}
        assert [got[i] for i in range(len(urls))] == want


def test_long_hosts_give_few_probes(spark):
    host = ".".join(["a"] * 20_000) + ".example.com"
    assert len(url_filter.probes(host, "/en/7", [4, 5], 11)) == 4 and url_filter.probes("xcom", "/en/", [4], 3) == [] == url_filter.probes("", "/en/", [4], 3)
    pages = spark.createDataFrame([(1, f"http://{host}/en/7"), (2, "http://com/en/")], "page_id long, url string")
    for limit in (1 << 20, 0):
        got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, url_filter.RULES, broadcast_bytes=limit).collect()}
        assert got == {1: "example.com/en/7", 2: "com/en/"}
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_warc_round_trip(spark):
    html = ["a", None, "a", "", "ü" * 5000, "a\r\n\r\nb\r\n\r\n", *["common"] * 2500]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\n" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = shared_dir(spark, "w")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert [got[i].record_type for i in range(6)] == ["revisit", "revisit", "response", "response", "response", "response"] and got[0].refers_to == 2
    assert len(got) == len(html) and got[6].refers_to == len(html) - 1
    records = {r.page_id: r for r in warc.reconstruct(spark, path).collect()}
    assert {i: r.payload.decode() for i, r in records.items()} == {i: h or "" for i, h in enumerate(html)}
    named, block = warc.parse(records[5].record)
    assert block == html[5].encode() and named["warc-target-uri"] == "http://h/5%0D%0A" and warc.parse(records[0].record)[1] == b""
    with pytest.raises(ValueError):
        warc.parse(records[5].record.replace(b"Content-Length: 10", b"Content-Length: 9"))
    warc.write_archive(pages.limit(0), path := shared_dir(spark, "w"))
    assert warc.read_archive(spark, path).count() == 0


def test_language_of_five_languages(spark):
    """Learned codes tell invented languages apart on held-out texts."""
    rng = np.random.default_rng(2)
    parts = [["the", "ing", "th", "er"], ["sch", "ung", "ein", "ch"], ["eau", "tion", "le", "é"], ["ción", "ñ", "que", "ar"], ["ssä", "kk", "tt", "inen"]]
    word = lambda k: "".join(rng.choice(parts[k], int(rng.integers(1, 4))))
    rows = [(i, " ".join(word(i % 5) for _ in range(30)), f"l{i % 5}") for i in range(600)]
    rows += [(1000, " ".join(word(j % 2) for j in range(400)), None), (1001, "1 2", "l1"), (1002, None, "l1"), (None, rows[0][1], "l0"), (1003, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("?"), "score": F.lit("?")})
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert np.mean([got[i].lang_pred == f"l{i % 5}" for i in held]) >= 0.95 and min(r.score for r in got.values()) >= 0 and max(r.score for r in got.values()) <= 1
    assert got[1000].lang_pred in ("l0", "l1") and not got[5].ambiguous and got[1003].score < 1
    # The flag is the margin between the two nearest codewords.
    assert all(r.ambiguous for r in langid.identify(df, margin=1.1).collect()) and not any(r.ambiguous for r in langid.identify(df, margin=0.0).collect() if r.lang_pred != "und")
    assert got[1001].lang_pred == "und" == got[1002].lang_pred and got[None].lang_pred == "l0"
    # The labels of held-out rows are not learned from.
    turned = df.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "l0").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(turned).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_empty_tables(spark):
    none = docs(spark, []).withColumns({"block": F.lit(1), "key": F.lit(1), "bucket": F.lit(1), "at": F.lit(1)})
    assert suffix_dedup.remove_repeats(none).count() == 0 and minhash_dedup.near_dedup(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert langid.identify(none).count() == 0 and mixing.mix(none).count() == 0 and packing.pack(none).count() == 0


def brute_links(ids, x, threshold=0.95):
    """(links of each row, smallest id reachable) of the rows of x."""
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= threshold
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


@pytest.mark.parametrize("tile,kind", [(3, "double"), (100, "double"), (16, "float")])
def test_embeddings_equal_brute_force(spark, tile, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype("f4" if kind == "float" else "f8")
    for k in range(0, 120, 3):  # chains of near vectors
        x[k + 1] = x[k] + rng.normal(size=8) * 0.13
        x[k + 2] = x[k + 1] * 3 + rng.normal(size=8) * 0.3
    x[150:300] = x[149] + rng.normal(size=(150, 8)) * 0.02  # one group of a third
    x[300:310] = x[0]
    ids = [*range(398), 7, 7]  # different vectors under one vec_id
    vecs = [(i, v.tolist(), 0) for i, v in zip(ids, x)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (None, x[0].tolist(), 0), (403, [1.0, 2.0], 0), (404, [], 0), (405, [2.0, 4.0], 1)]
    df = spark.createDataFrame(vecs, f"vec_id long, embedding array<{kind}>, label int")
    got = sorted(tuple(r)[:3] for r in embedding_dedup.embedding_dedup(df, tile=tile, steps=(2, 5)).collect() if r.vec_id is not None)
    n, component = brute_links(ids, x.astype("f8"))
    want = list(zip(ids, n.tolist(), component.tolist())) + [(400, 0, 400), (401, 0, 401), (402, 0, 402), (403, 1, 403), (404, 0, 404), (405, 1, 403)]
    assert got == sorted(want)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_hot_join_equals_join(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(9000)] + [(9001, None)], "i long, k string")
    owners = rows.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    got = hot_join(rows, owners, "k", F.col("n"), "left")
    assert got.count() == 9001 and got.where("k = 'a' and n = 6000").count() == 6000 and got.where("n is null").count() == 1
