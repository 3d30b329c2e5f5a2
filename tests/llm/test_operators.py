"""Each operator over small tables with all that may be odd, against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from rowlens.llm import decontaminate, langmodel, licenses, mixing, postings, quality, secretscan, simhash, substrings, tokencount, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, position double, fp binary, block long"


def prose(rng, n, letters="etaoinshrd"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, exact and near copies, repeated rows, a hot source and shared passages."""
    rng = random.Random(11)
    passage, long = prose(rng, 60), prose(rng, 20_000)
    texts = [None, "", " \n\t", "a", "Ünï cödé", passage, long, long + " end", "x" * 100_000, "w " * 200]
    texts += [prose(rng, rng.randrange(40, 160)) for _ in range(30)]
    texts += [prose(rng, 30) + " " + passage[20:] + "\n" + prose(rng, 30) for _ in range(6)] + [texts[12]] * 5
    words = texts[15].split()
    texts += [" ".join([*words[:7], "changed", *words[8:]])]
    out = [(i, t, "en", None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}", None) for i, t in enumerate(texts)]
    return [*out, (None, texts[11], None, None, None), out[14], out[14]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 0.5, b"x", 2) for r in rows], SCHEMA).repartition(3, "lang", "n_chars", "doc_id")


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("d") / "docs.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def got(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


def test_licenses(stored, empty, rows):
    auto = licenses.Automaton()
    assert got(licenses.scan(stored).drop("places")) == sorted(((i, *licenses.scan_text((t or "").encode(), auto)[:7]) for i, t in pairs(rows)), key=str)
    assert not licenses.scan(empty).collect()


def test_simhash(stored, empty, rows):
    found = simhash.near_duplicates(stored).selectExpr("doc_id", "lower(hex(fp)) f", "component_id")
    want = brute.simhash(pairs(rows))
    assert got(found) == want
    assert not simhash.near_duplicates(empty).collect()


def test_simhash_blocks_of_a_hot_value(spark, monkeypatch):
    import numpy as np

    rng, base = np.random.default_rng(4), 0x0123456789ABCDEF
    fps = {base ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2).astype(np.uint64))) for _ in range(120)} | {int(x) for x in rng.integers(0, 1 << 63, 60)}
    df = spark.createDataFrame([(struct.pack(">Q", x),) for x in fps], "fp binary")
    edges = simhash.links(df, 64, 3, 3, block=5)
    tree = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(edges).collect()}
    group = {struct.pack(">Q", x): {x} for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                a, b = group[struct.pack(">Q", x)], group[struct.pack(">Q", y)]
                if a is not b and bin(x ^ y).count("1") <= 3:
                    a |= b
                    for z in b:
                        group[struct.pack(">Q", z)] = a
                    changed = True
    signed = lambda b: b
    for b, members in group.items():
        low = min(struct.pack(">Q", z) for z in members)
        assert signed(tree.get(b, b)) == low
    assert edges.count() < 40 * len(fps)


def test_deduplicate_keeps_one_of_a_group(stored, rows, empty):
    kept = [r.doc_id for r in simhash.deduplicate(stored).collect()]
    assert len(kept) == len(set(kept)) and 12 in kept and 46 not in kept and 6 in kept and 7 not in kept and None in kept
    assert set(range(16, 40)) <= set(kept) and simhash.deduplicate(stored).columns == stored.columns
    assert not simhash.deduplicate(empty).collect()


def test_deduplicate_verifies_shingle_sets(spark, tmp_path):
    rng = random.Random(5)
    docs = {}
    for i in range(40):  # pairs with a set similarity of about 0.68: half of them lie within the candidates' bits
        shared = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for j in range(2):
            docs[2 * i + j] = " ".join([*shared, *(f"w{rng.randrange(10**6)}" for _ in range(93))])
    base = [f"v{rng.randrange(10**6)}" for _ in range(500)]
    for i in range(12):  # a chain whose neighbours have 0.85, whose ends have far less
        docs[100 + i] = " ".join([*base[40 * i :], *(f"u{j}" for j in range(40 * i))])
    docs |= {200: "a b c d e " * 40 + "f", 201: "a b c d e " * 40 + "g h i j k l m n"}  # equal in most bits, not in sets
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in docs:
        for j in docs:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    want = {min(j for j in docs if find(j) == find(i)) for i in docs}
    assert set(range(80)) <= want and len(want & set(range(100, 112))) == 1
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == want


@pytest.mark.parametrize("block", [None, 16])
def test_deduplicate_loses_no_candidate(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(simhash, "CLASS_SETS", block)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(300)]
    docs = {}
    for i in range(70):  # all have about 0.74 with one another, many are nearer in bits than the two of a pair with 0.81
        own = [word() for _ in range(52)]
        docs[i] = " ".join([*shared, *own])
        if i % 7 == 0:
            docs[1000 + i] = " ".join([*shared, *own[:15], *(word() for _ in range(37))])
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for i, t in docs.items()}
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = {x: root[i] if r == root[j] else r for x, r in root.items()}
    want = {min(j for j in docs if root[j] == r) for r in set(root.values())}
    assert len(want) == 70
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == want


def test_deduplicate_finds_pairs_that_are_far_apart_in_bits(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs, far = {}, 0
    for i in range(200):  # 160 of 198 shingles shared
        shared = [word() for _ in range(164)]
        pair = [" ".join([*shared, *(word() for _ in range(19))]) for _ in range(2)]
        sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in pair]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        docs |= {2 * i: pair[0], 2 * i + 1: pair[1]}
        one, two = simhash.fingerprints([t.encode() for t in pair], 5, 4)
        far += sum(int(x ^ y).bit_count() for x, y in zip(one, two, strict=True)) > simhash.bits_for(0.8, 256)
    assert far > 0
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == set(range(0, 400, 2))


def test_deduplicate_meets_rows_by_their_prefixes(spark, monkeypatch):
    """Pairs meet in numbers that grow with the texts: rows that are alike in bits of their fingerprints but share no shingle never do."""
    monkeypatch.setattr(simhash, "COMMON_SHARE", 0)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    line, docs = [word() for _ in range(12)], {}
    for i in range(60):  # a line that all share, each second text a near copy of the one before
        docs[2 * i] = " ".join([*line, *(own := [word() for _ in range(90)])])
        docs[2 * i + 1] = " ".join([*line, *own[:-3], *(word() for _ in range(3))])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    seen, real = [], simhash.sharing

    def counted(*args):
        seen.append(real(*args))
        return seen[-1]

    monkeypatch.setattr(simhash, "sharing", counted)
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == set(range(0, 120, 2))
    monkeypatch.setattr(simhash, "remove", lambda t: None)
    monkeypatch.setattr(simhash.scratch, "__exit__", lambda *_: None)
    simhash.deduplicate(df)
    sizes = [r["count"] for r in seen[-1].groupBy("key").count().collect()]
    assert sizes and max(sizes) == 2 and len(sizes) <= 120


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 9, 10, 40, 301):
        for _ in range(40):
            every = np.unique(rng.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64))
            lost = rng.integers(0, n // 5 + 1)
            one, two = every[:n], np.unique(np.concatenate([every[lost:n], every[n : n + max(0, n // 9 - lost)]]))
            if len(np.intersect1d(one, two)) < 0.8 * len(np.union1d(one, two)):
                continue
            by_rank = rng.permutation(np.unique(rng.choice(every, n)))
            rank = np.argsort(by_rank, kind="stable")
            a, b = (simhash.prefix(x, 0.8, by_rank[rank], rank) for x in (one, two))
            assert len(np.intersect1d(a, b)) and len(a) <= 0.2 * n + 1


def test_deduplicate_tells_rows_apart(spark):
    rng = random.Random(6)
    text = [prose(rng, 60) for _ in range(6)]
    rows = [(3, text[0]), (5, text[1]), (5, text[0]), (6, text[2]), (6, text[3]), (6, text[3]), (None, text[4]), (None, text[4]), (None, text[5]), (9, text[5])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(3, text[0]), (5, text[1]), (6, text[2]), (6, text[3]), (None, text[4]), (None, text[5])]
    assert got(kept) == sorted(want, key=str)


def test_warc(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    bodies = ["b" * 999, "c" * 1000, "é" * 700, None, "", prose(rng, 3000)]
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(bodies)) for i in range(40)] + [(None, None, "c" * 1000), (None, None, "only" * 400), (7, "u", bodies[1]), (7, "u", bodies[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({})
    want = []
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(i, top.get(t or "", i))
    for i, _, t in rows:
        b = (t or "").encode()
        revisit = len(b) >= 1000 and (t or "") in top and sum((x[2] or "") == (t or "") for x in rows) > 1 and i != top[t or ""]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[t or ""] if revisit else None))
    assert got(warc.round_trip(pages)) == sorted(want, key=str)
    assert not warc.round_trip(pages.limit(0)).collect()
    clashing = pages.selectExpr("*", "1 id", "'x' payload", "2 top", "3 key", "'y' sha1", "4 archive", "5 member", "6 n")
    assert got(warc.round_trip(clashing)) == sorted(want, key=str)
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/a", records=7, size=2000)  # archives bounded by rows and bytes
    back = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert sorted((r.id, r.payload_bytes, r.record_type) for r in back if r.record_type != "warcinfo" and r.id is not None) == sorted((w[0], w[1], w[3]) for w in want if w[0] is not None)
    archives = {}
    for r in sorted(back, key=lambda r: (r.archive, r.start)):
        archives.setdefault(r.archive, []).append(r)
    assert len(archives) > 6 and all(x[0].record_type == "warcinfo" and len(x) <= 8 and (x[-1].stop <= 2600 or len(x) == 2) and not any(y.gap_reason for y in x) for x in archives.values())


def test_substrings(stored, empty, rows):
    assert got(substrings.remove_repeats(stored)) == brute.substrings(pairs(rows))
    assert not substrings.remove_repeats(empty).collect()


@pytest.mark.parametrize("seed", range(3))
def test_substrings_with_few_words(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    out = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.read.parquet(f"{tmp_path}/d"), window=5).collect()}
    assert out == {d: n for d, _, n, _ in brute.substrings(rows, 5)}


def test_token_counts(stored, empty, rows, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokencount.model_path())
    tok.no_truncation()
    tok.no_padding()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in pairs(rows)]
    assert got(tokencount.count_tokens(stored)) == sorted(want, key=str)
    assert not tokencount.count_tokens(empty).collect()
    for name, value in (("BLOCK_BYTES", 20_000), ("BLOCK_ROWS", 5), ("SAMPLE_ROWS", 2)):  # several blocks in a partition
        monkeypatch.setattr(postings, name, value)
    monkeypatch.setattr(tokencount, "ROUND", 300)
    monkeypatch.setattr(tokencount, "KNOWN", 50)
    assert got(tokencount.count_tokens(stored.coalesce(1), head=20)) == sorted(want, key=str)
    assert got(tokencount.count_tokens(stored, head=0)) == sorted(want, key=str)




def test_quality(spark, stored, empty, rows):
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(5, 40)], "doc_id long, quality int, toxic int")
    judged = quality.judge(stored, labels)
    assert got(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((i, *brute.quality(t)) for i, t in pairs(rows)), key=str)
    assert not judged.where("kept and base_failed").collect()
    kept = sorted((r.doc_id for r in judged.where("kept").collect()), key=str)
    assert sorted((r.doc_id for r in quality.keep(stored, labels).collect()), key=str) == kept
    none = labels.limit(0)
    assert quality.judge(stored, none).where("kept = base_failed").count() == 0 and not quality.judge(empty, none).collect() and not quality.keep(empty, labels).collect()


def test_quality_sample_is_the_least_by_hash(spark, stored, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(5, 40)], "doc_id long, quality int, toxic int")
    seen = []
    make = quality.Forest.__init__
    monkeypatch.setattr(quality.Forest, "__init__", lambda self, rows, *a: seen.append(rows) or make(self, rows, *a))
    for n in (5, 20_000):
        monkeypatch.setattr(quality, "SAMPLE", n)
        quality.judge(stored, labels)
    few, whole = seen
    assert len(few) == 5 < len(whole) and (few == whole[:5]).all()


def test_clashing_names_in_the_pipeline(spark):
    rng = random.Random(3)
    names = ["__row", "__ROW_", "__n", "__keep", "__hash", "__rest", "hash", "rest", "fp", "root", "node", "mix", "mix_position", "mix_pass", "taken", "size", "h", "skey", "bucket", "a.b"]
    rows = [(i, prose(rng, 60) if i < 8 else "same text of a few words", f"s{i % 2}", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(9)) and {tuple(r)[3:] for r in kept.collect()} == {tuple(range(len(names)))}
    mixed = mixing.training_order(docs)
    assert mixed.columns == [*(c for c in docs.columns if c not in ("mix_position", "mix_pass")), "mix_pass", "mix_words", "mix_position"]
    assert sum(r.mix_words for r in mixed.collect()) == sum(r.taken for r in mixing.assign(docs).collect())


def test_mixing(stored, empty, rows):
    a = mixing.assign(stored).collect()
    assert len(a) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(brute.words(t))
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total = {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in order if s not in target]
        left = total - sum(target.values())
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
    by_size = {}
    for r in a:
        assert r.taken <= 2 * r.size and (r.position is None) == (r.first_taken == 0) and (r.position is None or 0 <= r.position <= 1)
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert {k: abs(sum(v) - k[1]) <= 0.5 for k, v in by_size.items()} == {(size[s], round(target[s], 6)): True for s in order}
    assert got(mixing.assign(stored)) == got(mixing.assign(stored.repartition(5)))
    one = stored.where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.training_order(one).collect()
    assert [r.mix_position for r in mixed] == sorted(r.mix_position for r in mixed) and sum(r.mix_words for r in mixed) == sum(r.taken for r in mixing.assign(one).collect())
    assert not mixing.assign(empty).collect() and not mixing.training_order(empty).collect()


def test_training_order_keeps_documents_without_or_with_shared_ids(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i // 2, f"t{i} " * (i % 7 + 1), f"s{i % 2}") for i in range(90)], "doc_id long, text string, source string")
    mixed = mixing.training_order(docs).collect()
    assert sum(r.mix_words for r in mixed) == sum(r.taken for r in mixing.assign(docs).collect())
    passes = [(r.text, r.mix_pass) for r in mixed]
    assert len(passes) == len(set(passes)) and any(r.doc_id is None for r in mixed)


def test_schedules_tilt_positions(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    mean = {}
    for r in mixing.training_order(docs).collect():
        mean.setdefault(r.source, []).append(r.mix_position)
    flat, late, early = (sum(mean[s]) / len(mean[s]) for s in ("s0", "s1", "s2"))
    assert early < flat < late


def test_decontamination(spark, stored, empty, rows, monkeypatch):
    items = [(1, rows[20][1][10:150]), (2, None), (3, ""), (None, rows[21][1][:120]), (5, prose(random.Random(99), 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(stored, bench).collect()}
    assert found == {20: [1], 21: [-1]}
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", 100))
    assert {r.doc_id: r.item_ids for r in decontaminate.find_leaks(stored, bench).collect()} == found
    kept = sorted((r.doc_id for r in decontaminate.drop_leaks(stored, bench).collect()), key=str)
    assert kept == sorted((r[0] for r in rows if r[0] not in found), key=str)
    assert not decontaminate.find_leaks(empty, bench).collect() and not decontaminate.find_leaks(stored, bench.limit(0)).collect()


def test_decontamination_against_brute_force(spark):
    rng = random.Random(17)
    items = [(i, prose(rng, n, "etaoin")) for i, n in enumerate((1, 1, 2, 6, 12, 20, 25, 60))]
    texts = []
    for _ in range(60):
        t = prose(rng, 30, "etaoin")
        if rng.random() < 0.6:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice(["", "q", "xy", piece[at]])
            t = f"{t} {''.join(piece)} {prose(rng, 20, 'etaoin')}"
        texts.append(t)
    want = []
    for d, t in enumerate(texts):
        line = decontaminate.normal(t.encode()).decode()
        found = []
        for i, x in items:
            p = decontaminate.normal(x.encode()).decode()
            if len(p) < decontaminate.Q:
                ok = f" {p} " in f" {line} "
            else:
                span, step = decontaminate.SPAN, decontaminate.STEP
                stretches = [p] if len(p) <= span else [p[a : a + span] for a in [*range(0, len(p) - span, step), len(p) - span]]
                ok = any(brute.edits(s, line) <= decontaminate.budget(len(s)) for s in stretches)
            found += [i] if ok else []
        if found:
            want.append((d, found))
    docs = spark.createDataFrame([(d, t, "clash") for d, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, doc_id long")
    assert [(r.doc_id, r.item_ids) for r in decontaminate.find_leaks(docs, bench).orderBy("doc_id").collect()] == want and len(want) > 20
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == sorted(set(range(60)) - {d for d, _ in want})


def scored_as(out, want):
    return [x[:5] for x in out] == [x[:5] for x in want] and all(abs(x[5] - y[5]) < 1e-6 * abs(y[5]) + 1e-9 for x, y in zip(out, want, strict=True))


def test_language_model(stored, empty, rows, monkeypatch):
    out = got(langmodel.score(stored))
    want = sorted(brute.language_model(pairs(rows)), key=str)
    assert scored_as(out, want) and all(x[6] < 0 for x in out) and not langmodel.score(empty).collect()
    assert out == got(langmodel.score(stored))
    for name, value in (("BLOCK_BYTES", 20_000), ("BLOCK_ROWS", 5), ("SAMPLE_ROWS", 2)):
        monkeypatch.setattr(postings, name, value)
    assert scored_as(got(langmodel.score(stored.coalesce(1), head=30)), want) and scored_as(got(langmodel.score(stored, head=0)), want)
    none = stored.where("doc_id is null")
    assert scored_as(got(langmodel.score(none)), sorted(brute.language_model([(None, rows[11][1])]), key=str))


def test_language_model_takes_its_slots_from_all_training_texts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, 6) if i < 700 else f"late{i % 40} " * (3 + i % 7) + "x" * 50) for i in range(1000)]  # the common tokens stand last
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % langmodel.HELD_OUT:
            count.update([*(w for w in t.encode().split() if len(w) <= langmodel.KEY_BYTES), b""])
    want = sorted(count, key=lambda w: (-count[w], w))
    docs = spark.read.parquet(f"{tmp_path}/d")
    for n in (1, 25, 60, 10**6):
        assert langmodel.layout_of(docs, head=n).array.to_pylist() == want[:n]
        assert langmodel.layout_of(docs.repartition(7, "doc_id"), head=n).array.to_pylist() == want[:n]
    assert sum(w.startswith(b"late") for w in want[:60]) > 30


def test_language_model_beats_single_words_on_held_out_texts(spark, tmp_path):
    rng = random.Random(2)
    chain = {w: [f"w{(i * 7 + j) % 60}" for j in (1, 2)] for i, w in enumerate(f"w{i}" for i in range(60))}
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(60)}"]
        for _ in range(80):
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    held = langmodel.score(spark.read.parquet(f"{tmp_path}/d")).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert held.s > held.b + 0.2


def test_language_model_gains_on_held_out_documents(spark):
    held = langmodel.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert held.s > held.b + 0.1


def test_secrets(stored, empty, rows, spark):
    assert got(secretscan.scan(stored), 5) == sorted(((i, *brute.secrets(t)) for i, t in pairs(rows)), key=str)
    df = spark.createDataFrame([(1, "é token = 'abcdefabcdefabcdef' end", 9), (2, None, None), (3, "clean", 77)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secretscan.redact(df).collect()] == [(1, "é [SECRET]' end", 15), (2, None, None), (3, "clean", 77)]
    assert not secretscan.scan(empty).collect() and not secretscan.redact(empty).collect()


def test_pipeline_stages(spark, stored, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(10, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[20][1][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stored.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (i == 4 or len(docs.columns) == 5)
    ids = {r.doc_id for r in docs.collect()}
    assert 20 not in ids and 0 not in ids and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
