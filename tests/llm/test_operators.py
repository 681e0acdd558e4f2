"""The operators against brute force on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import decontamination, minhash, mixing, pii, quality, sharding, tokens, toxicity, warc, webp
from lakewarden.llm.shared import ship

RNG = random.Random(11)
VOCAB = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "über", "kappa."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, copies string, __key string"


def words(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def table(spark, texts, sources=None):
    ship(spark)
    rows = [(i, t, None, (sources or [None, "b", "a"])[i % 3] if not sources else sources[i], 0, 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = [words(RNG.randint(20, 60)) for _ in range(25)]
    near = [" ".join(w if k != 5 else "changed" for k, w in enumerate(b.split())) for b in base[:8]]
    return [*base, *near, *base[:6], base[0].upper(), None, "", " \t\n", "one", "one", "two words", words(30_000)]


EMPTY = []


def test_near_duplicates_match_brute_force(spark, texts):
    for size, percent in ((3, 85), (5, 80)):
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
        group = list(range(len(texts)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    x, y = group[i], group[j]
                    group = [min(x, y) if g in (x, y) else g for g in group]
        rows = minhash.near_duplicates(table(spark, texts), size, percent).collect()
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
        assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in range(len(texts))}
    assert minhash.near_duplicates(table(spark, EMPTY)).count() == 0


def test_blocks_of_a_large_open_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    copies = []
    for _ in range(50):
        own = list(base)
        for k in RNG.sample(range(60), RNG.randint(0, 5)):
            own[k] = f"x{RNG.randint(0, 3)}"
        copies.append(" ".join(own))
    test_near_duplicates_match_brute_force(spark, copies)


def test_a_link_to_a_chained_member_of_a_far_hub_is_found(spark):
    # Sets of 100 of consecutive words; each links (0.8) with the next one, node 3 with node 2 alone.
    sets = [set(range(10 * k, 10 * k + 100)) for k in range(4)]
    texts = spark.createDataFrame([(k, " ".join(f"w{i}" for i in s)) for k, s in enumerate(sets)], "node long, text string")
    measured = spark.createDataFrame([(k, 0, len(sets[k] & sets[0]), 100, 100) for k in (1, 2, 3)], "node long, hub long, both long, n_node long, n_hub long")
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node long, root long")
    got = minhash.leftover_links(measured, roots, texts, 1, 80).collect()
    assert [{r.a, r.b} for r in got] == [{0, 3}]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {}
    for r in minhash.components(df).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [30, 41]


def naive_hits(text, items):
    w = decontamination.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = decontamination.words_of(t)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"block_bytes": 40}])
def test_decontamination_matches_brute_force(spark, texts, options):
    items = [(1, texts[2]), (2, "Alpha, BETA"), (10, "kappa"), (3, None), (4, "!!"), (5, words(12)), (5, texts[3]), (6, "never seen here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = [*texts[:-1], words(400) + " " + (texts[3] or ""), "eta " * 50]
    rows = decontamination.mark_contaminated(table(spark, own), bench, **options).collect()
    assert len(rows) == len(own)
    for r in rows:
        n, hit, found = naive_hits(own[r.doc_id], items)
        assert (r["words"], list(r["items"])) == (n, found)
        assert {p for s in r["spans"] for p in range(s.a, s.b)} == hit
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_contaminated(table(spark, own), empty).count() == len(own)


def test_suffix_array_of_repeats():
    import numpy as np

    for text in ([2, 2, 2, 2, 1, 2, 2, 0], [3, 1, 3, 1, 3, 1, 0], [2] * 200 + [0], [0]):
        s = np.array(text, np.int64)
        assert decontamination.suffix_array(s, 2).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("sizes", [(8, 20_000), (3, 5)])
def test_shards(spark, texts, sizes):
    shards, bucket = sizes
    own = table(spark, texts, ["big" if i % 3 else None for i in range(len(texts))])
    own = own.unionByName(own.limit(4))
    rows = sharding.assign_shards(own, shards=shards, bucket_rows=bucket).toPandas()
    assert len(rows) == len(texts) + 4
    counts = rows.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    for r in rows.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    mixture = rows.assign(null=rows.doc_id % 3 == 0).groupby("shard")["null"].sum()
    assert mixture.max() - mixture.min() <= 2
    assert sharding.assign_shards(table(spark, EMPTY)).count() == 0


def test_mixing_targets_and_takes(spark):
    texts = [words(RNG.randint(0, 40)) for _ in range(600)] + [None, ""]
    sources = [["s1", "s2", "s3", None][min(i % 17 // 4, 3)] for i in range(602)]
    rows = mixing.mix(table(spark, texts, sources)).toPandas()
    docs = pd.DataFrame({"doc_id": range(602), "source": [s or "~" for s in sources]})
    m = rows.merge(docs, on="doc_id")
    total = rows["size"].sum()
    sizes = m.groupby("source")["size"].sum()
    weight = dict(zip(["s1", "s2", "s3", "~"], [1, 2, 3, 1], strict=True))
    target, open_ = {}, dict(weight)
    while True:
        level = (total - sum(target.values())) / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    for s, group in m.groupby("source"):
        assert group["target"].iloc[0] == pytest.approx(target[s])
        assert abs((group["copies"] * group["size"]).sum() - target[s]) <= 25
    assert rows["copies"].max() <= 3
    again = mixing.mix(table(spark, texts, sources).repartition(7)).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert mixing.mix(table(spark, EMPTY)).count() == 0


def test_archives(spark):
    ship(spark)
    html = [None, "", "<p>ü</p>\r\n\r\n", "<p>ü</p>\r\n\r\n", "WARC/1.1\r\n\r\n", "x" * 200_000, "😀"]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}\r\nX: y", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages.repartition(3))
    rows = {r.page_id: r for r in warc.read_records(index).collect()}
    for i, h in enumerate(html):
        data, r = (h or "").encode(), rows[10 - i]
        first = min(10 - k for k, o in enumerate(html) if (o or "") == (h or ""))
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "response" if first == 10 - i else "revisit", None if first == 10 - i else first)
        assert r.html == ((h or "") if first == 10 - i else None)
    assert warc.read_records(index.where("page_id in (4, 9)")).count() == 2
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_reads_coalesce():
    assert warc.plan_reads([(0, 10), (10, 5), (100, 5), (130, 9)], gap=20, most=30) == [(0, 15, 0, 2), (100, 5, 2, 3), (130, 9, 3, 4)]


def test_token_counts_match_greedy_matching(spark, texts):
    vocab = set(tokens.read_vocabulary())
    longest = max(map(len, vocab))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at = next(end for end in range(min(len(word), at + longest), at, -1) if word[at:end] in vocab)
            n += 1
        return n

    own = [*texts[:-1], "naïve 😀 <|endoftext|> " + "z" * 300]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(table(spark, own)).collect()}
    for i, t in enumerate(own):
        parts = (t or "").encode().split()
        assert got[i] == (len(parts), sum(greedy(b" " + w) for w in parts))


def test_automaton_without_cover_counts_one():
    a = tokens.Automaton([b"ab", b"abc", b"d"])
    assert [a.count(w) for w in (b"abcd", b"abd", b"abx", b"x", b"", b"abab")] == [2, 2, 1, 1, 0, 2]


def labelled(spark, n=1500):
    ship(spark)
    rng = random.Random(5)
    filler = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ko", "vi", "pel", "dra")]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(filler) for _ in range(rng.randint(20, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                own[rng.randrange(len(own))] = "vex" + rng.choice(filler)
        low = i % 4 == 0
        text = "!! ".join(own).upper() if low else " ".join(own) + "."
        docs.append((i, text, "t", 7))
        labels.append((i, 0 if low else 1, int(bad)))
    docs += [(n, None, "t", 7), (n + 1, "", "t", 7), (n + 2, docs[0][1], "t", 7)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(scores, truth):
    order = pd.Series(scores).rank()
    pos = truth.sum()
    return (order[truth == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_scores_on_held_out_rows(spark, kind):
    docs, labels = labelled(spark)
    if kind == "toxic":
        scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), score_column="__p")
        held = lambda i: toxicity.crc_fold(i, 5) == 0
    else:
        scored = quality.score_quality(docs, quality.train(docs, labels), score_column="__p")
        held = lambda i: toxicity.crc_fold(i, 3) == 1
    got = scored.toPandas()
    assert len(got) == 1503 and got["__p"].between(0, 1).all()
    by = got.set_index("doc_id")["__p"]
    assert by[1500] == by[1501] and by[1502] == by[0]
    m = got.merge(labels.toPandas()[["doc_id", kind]].rename(columns={kind: "y"}), on="doc_id")
    m = m[m.doc_id.map(held)]
    assert auc(m["__p"].to_numpy(), m["y"].to_numpy()) > 0.97
    none = labels.limit(0)
    flat = (toxicity.score_toxicity(docs, toxicity.train(docs, none), score_column="__p") if kind == "toxic" else quality.score_quality(docs, quality.train(docs, none), score_column="__p"))
    assert flat.select("__p").distinct().count() == 1


def test_words_of_one_bucket_keep_their_own_evidence(spark):
    many = [f"q{i:05d}x" if i % 2 else f"{i:05d}zz" for i in range(6000)]
    w = toxicity.Words([" ".join(many).encode()])
    bucket = (w.hash >> np.uint64(45)).astype(int)
    stem = (w.hash_of(w.start, w.prefix_end(4)) >> np.uint64(46)).astype(int)
    order = np.argsort(bucket, kind="stable")
    near = [tuple(sorted((i, j), key=lambda k: stem[k])) for i, j in zip(order, order[1:], strict=False) if bucket[i] == bucket[j] and stem[i] != stem[j]]
    bad, good = (many[k] for k in near[0])
    rng, rows, labels = random.Random(3), [], []
    for i in range(200):
        rows.append((i, " ".join(f"n{rng.randint(0, 400)} {bad if i % 2 else good}" for _ in range(30))))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    own = toxicity.Words([f"{bad} {good} zzzzzz".encode()], wordlike=toxicity._WORDLIKE)
    one, other, unseen = toxicity.model_differences(model.other, own, model.block(0).evidence(own))[1]
    assert one > 1 and other < -1 and abs(unseen) < 1


def rules(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_personal_data_rules_match_python(spark):
    parts = ["a", "@", ".", "1", "25", "255", " ", "-", "+", "(", ")", "é", "😀", "c.d", "@x.y", "_", "4111 1111 1111 1111", "+1 555 123 4567", "password=abc123def456"]
    own = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 40))) for _ in range(400)] + [None, "", "1 " * 20_000, "a@b" + ".c" * 20_000]
    rows = {r.doc_id: r for r in pii.find_pii(table(spark, own)).collect()}
    assert len(rows) == len(own)
    for i, t in enumerate(own):
        expected = rules(t or "") if len(t or "") < 10_000 else [("email", 0, len(t))] if "@" in t else []
        assert [(s.kind, s.s, s.e) for s in rows[i].base] == expected
        for x in rows[i].extra:
            assert not any(x.s < e and s < x.e for _, s, e in expected)


def test_personal_data_query_has_the_form_of_its_contract(spark, tmp_path):
    own = [None, "", "😀 a@b.de and 10.0.0.1, c@d.org", "password=abc123def456 for +1 555 123 4567", "4111 1111 1111 1111 or 4111 1111 1111 1112", "clean words", "clean words"]
    table(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(own)
    for r in rows:
        base = rules(own[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        listed = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        order = [*pii.BASE, *pii.EXTRA_ORDER]
        assert listed == sorted(listed, key=lambda x: (order.index(x[0]), x[1])) and set(base) <= set(listed)
        assert (r.n_spans, r.n_extra) == (len(listed), len(listed) - len(base))
    assert {r.doc_id: r.n_extra for r in rows} == {i: int(i == 3) for i in range(len(own))}


def test_selected_proposals(spark):
    own = ['token = "' + "0a1b" * 10 + '"', "password=b7db7aa4a5fcc78305 x", "call 555-123-4567 now", "iban DE89 3704 0044 0532 0130 00.", "on 12 345 678 and 1999 123 456", "key = value", "a@b.de"]
    rows = {r.doc_id: [own[r.doc_id][x.s : x.e] for x in r.extra] for r in pii.find_pii(table(spark, own)).collect()}
    assert "0a1b" * 10 in rows[0][0] and rows[1] == ["password=b7db7aa4a5fcc78305"] and rows[2] == ["555-123-4567"]
    assert rows[3] == ["DE89 3704 0044 0532 0130 00"] and rows[4] == rows[5] == rows[6] == []


def test_secrets_are_proposed_whole_and_in_any_case(spark):
    rng = random.Random(5)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    both = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    jwt = f"{pick(both, 36)}.{pick(both, 159)}.{pick(both, 43)}"
    secrets = [f"token={jwt}", f"sk-{pick(both, 120)}", pick("0123456789abcdef", 128), pick("0123456789ABCDEF", 64), "API_KEY=abc123def456", "Password: abc123def456"]
    rows = pii.find_pii(table(spark, [f"the key {x} and more" for x in secrets])).collect()
    got = {r.doc_id: [(x.s, x.e) for x in r.extra] for r in rows}
    assert got == {i: [(8, 8 + len(x))] for i, x in enumerate(secrets)}


def test_media(spark, texts):
    own = [*texts, "x" * 576]
    for r in webp.read_media(webp.store_texts(table(spark, own))).collect():
        data = (own[r.doc_id] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:])


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 400)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leak = docs.where("doc_id = 3").first().text
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, own = own, stage(spark, own, str(tmp_path))
        assert own.columns == before.columns, name
    kept = {r.doc_id for r in own.collect()}
    assert 3 not in kept and not {402} & kept and len(kept) > 250
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= kept and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
