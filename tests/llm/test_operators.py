"""Each operator against plain loops on a small table with every odd case."""

import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chronolith.llm import bktree, decontam, gam, licences, linededup, lm, packing, pii, rules, simhash, textstats, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_chunks int, label int"
rng = random.Random(7)
VOCABULARY = ["the", "of", "und", "la"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(600)]


def prose(n, lines=12):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + lines]) for i in range(0, n, lines))


LONG = prose(180, 60)
ITEM = prose(24, 24)
TEXTS = [
    None, "", " \n\t ", "one", "Two words", "a b c d", LONG, LONG, LONG.replace(LONG.split()[50], "changed"), LONG.upper(),
    "x" * 5000, "word " * 3000, prose(4000), f"{prose(30)}\n{ITEM}\n{prose(20)}", ITEM.upper(), "Licensed under CC BY-NC 4.0.",
    "é" * 50 + " naïve Ünïcode ﬁ   \x85 z", "mail a.b@c.example.com or +1 (017) 555-7713, 4111 1111 1111 1111 and 10.0.0.256 10.0.0.25.",
    *[prose(rng.randint(1, 300)) for _ in range(40)],
]
ROWS = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, 0) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[0], (None, LONG, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def rows(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_simhash(docs, none):
    def print_of(text):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in white(text)]
        each = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(r[1]) for r in ROWS]
    label = list(prints)
    for _ in ROWS:
        label = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4) for p in prints]
    least = {}
    for r, at in zip(ROWS, label):
        if r[0] is not None:
            least[at] = min(least.get(at, r[0]), r[0])
    want = sorted(([r[0], format(p, "016x"), least.get(at)] for r, p, at in zip(ROWS, prints, label)), key=repr)
    assert rows(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(none).count() == 0


def test_bk_forest_and_hot_shards(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8))]))
    shard = np.sort(r.integers(0, 3, len(prints)))
    q, e = bktree.Forest(prints, shard).search(prints, shard, 4)
    brute = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if shard[i] == shard[j] and int(prints[i] ^ prints[j]).bit_count() <= 4}
    assert set(zip(q.tolist(), e.tolist())) == brute
    # parts of a shard meet each other, whatever the part's size
    monkeypatch.setattr(simhash, "SHARD", 16)
    df = spark.createDataFrame([(int(p.astype(np.int64)),) for p in prints], "fp long")
    near = simhash.links(df, 4)
    from chronolith.llm.graph import components

    root = {x.node: x.root for x in components(near).collect()}
    signed = prints.astype(np.int64)
    label = bktree.labels_of(len(prints), *np.array([(i, j) for i in range(len(prints)) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 4]).T)
    mine = [root.get(int(s), int(s)) for s in signed]
    assert len(set(zip(mine, label.tolist()))) == len(set(mine)) == len(set(label.tolist()))


def test_components_with_hubs(spark, monkeypatch):
    """A star, chains and loops, with hubs sent to all and without."""
    from chronolith.llm import graph

    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (131, 59), (300, 301), (301, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    label = bktree.labels_of(600, *np.array(edges).T)
    want = {i: int(x) for i, x in enumerate(label.tolist()) if x != i}
    df = spark.createDataFrame(edges, "u long, v long")
    for least in (1000, 5):
        monkeypatch.setattr(graph, "HUB_LEAST", least)
        assert {r.node: r.root for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_masks_cover_every_near_pair(n):
    every = simhash.masks(n)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a & (m % 2**64)) == (b & (m % 2**64)) for m in every)


def united(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near_pairs(texts):
    """All pairs of word sequences with a cosine of 0.8 or more, by plain sets; and the nodes with their fingerprints."""
    seen = {simhash.content_prints(t.encode())[:2]: alnum(t) for t in texts}
    nodes = [(n, np.frombuffer(s, np.uint64), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for (n, s), w in seen.items()]
    pairs = [(m, n, int(np.bitwise_count(s ^ t).min())) for i, (m, s, x) in enumerate(nodes) for n, t, y in nodes[:i] if len(x & y) >= 0.8 * (len(x) * len(y)) ** 0.5]
    return pairs, [n for n, _, _ in nodes]


def test_near_duplicate_groups_lose_no_link(spark, monkeypatch):
    """Candidates of every forest may fail while one left out of it holds; all are compared in the end."""
    monkeypatch.setattr(simhash, "LATE", 16)  # parts that meet pairwise
    texts = []
    for _ in range(6):
        base = prose(60).split()
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(60)] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs, nodes = near_pairs(texts)
    close = [(a, b) for a, b, far in pairs if far <= 4]
    got = {n: n for n in nodes} | {r.node: r.root for r in simhash.near_duplicate_groups(df).collect()}
    most = united([p[:2] for p in pairs], nodes)
    assert len(close) > 50 and 6 < len(set(got.values())) < len(nodes) - 20
    assert all(got[a] == got[b] for a, b in close)  # no link between candidates is lost
    assert all(most[n] == most[r] for n, r in got.items())  # and none made that does not hold


def test_near_duplicates_found(spark):
    """Against all pairs: words changed here and there, and blocks put in or cut out, of texts of 60 to 500 words."""
    texts = []
    for i in range(160):
        words = prose(rng.randint(60, 500)).split()
        texts.append(" ".join(words))
        at, n = rng.randrange(len(words)), max(1, len(words) * rng.randint(1, 18) // 100)
        if i % 3 == 0:
            words[at:at] = prose(n).split()
        elif i % 3 == 1:
            del words[at : at + n]
        else:
            for _ in range(max(1, len(words) // 50)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    pairs, nodes = near_pairs(texts)
    got = {n: n for n in nodes} | {r.node: r.root for r in simhash.near_duplicate_groups(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()}
    assert len(pairs) > 120 and np.mean([got[a] == got[b] for a, b, _ in pairs]) >= 0.95
    most = united([p[:2] for p in pairs], nodes)
    assert all(most[n] == most[r] for n, r in got.items())


@pytest.mark.parametrize("part", [4096, 40])
def test_texts_of_a_common_segment_lose_no_link(spark, monkeypatch, part):
    """A passage in all texts: copies of a text differ in size, so many others stand between them."""
    monkeypatch.setattr(simhash, "SEGMENT_PART", part)  # a segment's texts in one part, or in several
    monkeypatch.setattr(simhash, "SHARD", 32)
    monkeypatch.setattr(simhash, "LATE", 16)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    passage, texts = [word() for _ in range(70)], []
    for _ in range(120):
        body = [word() for _ in range(30)]
        same, more = body[: draw.randint(16, 22)], [word() for _ in range(draw.randint(0, 8))]
        texts += [" ".join(passage + body), " ".join(passage + same + more)]
    pairs, nodes = near_pairs(texts)
    held = {simhash.content_prints(t.encode())[0]: simhash.content_prints(t.encode())[2] for t in texts}
    common = [(a, b) for a, b, _ in pairs if {held[a][i : i + 8] for i in range(0, len(held[a]), 8)} & {held[b][i : i + 8] for i in range(0, len(held[b]), 8)}]
    got = {n: n for n in nodes} | {r.node: r.root for r in simhash.near_duplicate_groups(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()}
    most = united([p[:2] for p in pairs], nodes)
    assert len(common) > 60 and len(set(most.values())) > 100
    assert all(got[a] == got[b] for a, b in common)
    assert all(most[n] == most[r] for n, r in got.items())


def test_segments_outlive_blocks():
    words = [w.encode() for w in prose(400).split()]
    whole, cut = (np.frombuffer(simhash.segments(w), ">u8") for w in (words, words[:200] + words[230:]))
    assert 0 < len(whole) <= simhash.SEGMENTS and set(whole) & set(cut) and list(whole) == sorted(whole)
    assert simhash.segments([]) == b"" and simhash.segments([b"a"]) == b""


def test_slices_keep_shards_whole():
    shard = np.repeat(np.arange(9), [1, 30, 2, 2, 2, 40, 1, 1, 1])
    table = pa.table({"shard": shard, "x": np.arange(len(shard))})
    got = list(simhash._bounded(iter([table, table.slice(0, 0)]), 100))
    assert pa.concat_tables(got).equals(table)
    assert [set(t.column("shard").to_pylist()) for t in got] == [{0}, {1}, {2, 3, 4}, {5}, {6, 7, 8}]


def test_drop_near_duplicates(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert kept.count() == len(ids)
    assert {0, 6, 12, 13} <= ids and not {None, 1, 2, 7, 8, 9} & ids
    assert {i for i in range(18, 58)} <= ids
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("order", [1, 3])
def test_word_scores(docs, none, order, monkeypatch):
    """Against plain counts of all other rows; the count of distinct n-grams grows with the words."""
    monkeypatch.setattr(lm, "WORD_BYTES", 3000)
    monkeypatch.setattr(lm, "ROW_KEYS", 1)
    texts = [lm.words_of(r[1].encode() if r[1] else None) for r in ROWS]

    def counted(some):
        count = {}
        for w in some:
            marked = [b"\x02"] * (order - 1) + w if w else []
            for i in range(max(order - 2, 0), len(marked)):
                for k in range(1, order + (i >= order - 1)):
                    g = tuple(marked[i - k + 1 : i + 1])
                    if i - k + 1 >= 0:
                        count[g] = count.get(g, 0) + 1
        return count

    every, n_words = counted(texts), sum(map(len, texts))
    want = []
    for r, w in zip(ROWS, texts):
        own, rest, log = counted([w]), max(n_words - len(w), 1), 0.0
        marked = [b"\x02"] * (order - 1) + w

        def score(g):
            n = every[g] - own[g]
            if len(g) == 1:
                return (n or 0.4) / rest
            return n / (every[g[:-1]] - own[g[:-1]]) if n else 0.4 * score(g[1:])

        for i in range(len(w)):
            log += np.log(score(tuple(marked[i : i + order])))
        want.append((-1 if r[0] is None else r[0], len(w), log))
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_grams, r.log_prob) for r in lm.word_scores(docs, order).collect())
    assert [x[:2] for x in mine] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in mine], [x[2] for x in sorted(want)], atol=1e-4)
    assert lm.word_scores(none, order).count() == 0
    assert lm.words_of("Ab \u4e2d\u6587 é".encode()) == [b"ab", "\u4e2d".encode(), "\u6587".encode(), "é".encode()]


def test_lm_query_counts_words(spark, tmp_path):
    """Word order counts: a text that occurs twice scores above its words in another order."""
    from chronolith.llm import queries

    base = prose(200).split()
    other = rng.sample(base, len(base))
    rows_ = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(other)), *((10 + i, prose(200)) for i in range(8))]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.doc_id: r.mean_log_prob for r in queries.op2_lm_score(spark, str(tmp_path)).collect()}
    assert by[1] == by[2] > by[3] + 3


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 600
    data = [(1, "http://a", big), (2, "u\r\nx: y", big), (3, None, "short"), (4, "c", "short"), (5, "d", None), (6, "e", ""), (7, "f", big[:-1] + "x"), (2, "again", big), (None, "n", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect()}
    want = set()
    for i, _, html in data:
        raw = (html or "").encode()
        again = html == big and i == 1
        want.add((i, "revisit" if again else "response", 2 if again else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == want
    # a page_id may have several rows, with other payloads and urls
    bodies = [big, big + "y", "short", None, "x" * 999, "x" * 1000, "z" * 1000]
    many = [(rng.choice([None, *range(6)]), f"u{i}", rng.choice(bodies)) for i in range(120)]
    out = rows(warc.round_trip(spark.createDataFrame(many, pages.schema).repartition(5)), "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    want = []
    for i, _, html in many:
        raw = (html or "").encode()
        top = max((j for j, _, h in many if h == html and j is not None), default=None) if len(raw) >= 1000 else None
        again = i is not None and top is not None and top != i
        want.append([i, "revisit" if again else "response", top if again else None, len(raw), hashlib.sha1(raw).hexdigest()])
    assert out == sorted(want, key=repr)
    warc.write_pages(pages, str(tmp_path / "w"))
    heads = warc.read_pages(spark, str(tmp_path / "w"), payload=False)
    assert heads.where("payload is not null").count() == 0 and heads.where("record_type = 'revisit'").count() == 1
    plan = heads.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quality_rules(docs, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(docs).collect()}
    want = set()
    for r in ROWS:
        text, words = r[1] or "", white(r[1])
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(set(windows)) < len(windows) and len(windows) < 5000 else set()
        lines = [x for x in text.split("\n") if white(x)]
        want.add((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)))
    assert got == want
    assert rules.quality_rules(docs).where("kept and base_failed").count() == 0
    assert rules.quality_rules(none).count() == 0


def test_quality_rules_judge_short_texts(spark):
    """Word soup of 50 to 199 words in usual letters goes, clean texts as short stay."""
    often, seldom = rules.COMMON["en"].split(), ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 9))) for _ in range(2000)]
    clean = [" ".join(rng.choice(often[:8] if i % 2 else seldom) for i in range(n)) for n in range(50, 200, 3)]
    junk = [" ".join(rng.choice(seldom) for _ in range(n)) for n in range(50, 200, 15)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in rules.quality_rules(df).where("kept").collect()}
    assert kept == set(range(len(clean)))


def test_quality_rules_by_plain_loops(spark):
    """References, distances and verdicts, against loops over whole texts; a fifth language and a rare one too."""
    often = {k: v.split() for k, v in rules.COMMON.items()}
    odd = ["".join(rng.choice("абвгдежзик") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = []
    for i in range(90):
        lang = ("en", "de", "ru", "en", None)[i % 5] if i < 86 else "rare"
        words = odd if lang in ("ru", "rare") else VOCABULARY + often.get(lang, often["en"]) * 8
        texts.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(40, 260))) + "." * (i % 3), lang))
    texts += [(100 + i, " ".join("#$%" + rng.choice(VOCABULARY) for _ in range(90)), "en") for i in range(2)] + [(200, None, "en"), (201, "", None)]

    def hists(text):
        raw, words = text.encode(), text.split()
        c = textstats.class_counts(raw).tolist()
        w = [0] * len(rules.WORDS)
        for x in words:
            if (y := x.strip(".,").lower()) in rules.WORDS and len(x.encode()) < 8:
                w[rules.WORDS.index(y)] += 1
        return [x / sum(c) for x in c], [x / len(words) for x in (*w, len(words) - sum(w))]

    def distance(p, q):
        mid = [(a + b) / 2 for a, b in zip(p, q)]
        kl = sum(a * np.log2(a / m) for x in (p, q) for a, m in zip(x, mid) if a > 0)
        return max(kl / 2, 0) ** 0.5

    held = {i: hists(t) for i, t, _ in texts if t}
    bad = {r[0]: r[6] for r in rows(rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string")), "doc_id", *rules.OUT, "base_failed")}

    def refs(ids):
        out = {}
        for lang in {x[2] for x in texts if x[2]}:
            mine = [held[i] for i, _, k in texts if k == lang and i in ids]
            if len(mine) >= rules.LEAST_DOCS:
                out[lang] = tuple([sum(h[n][j] for h in mine) / len(mine) for j in range(len(mine[0][n]))] for n in (0, 1))
        return out

    def judged(of):
        out = {}
        for i, t, lang in texts:
            n = len((t or "").split())
            near = [min(distance(held[i][k], r[k]) for r in of.values()) if t else None for k in (0, 1)]
            far = bool(t) and (near[0] > rules.FAR_CLASSES or near[1] > float(rules.far_words(np.array([n]))[0])) and (lang is None or lang in of)
            out[i] = (near, far)
        return out

    sound = {i for i in held if not bad[i]}
    first = judged(refs(sound))
    last = judged(refs({i for i in sound if not first[i][1]}))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, (near, far) in last.items():
        if held.get(i):
            assert np.allclose([got[i].class_distance, got[i].word_distance], near, atol=1e-9)
        assert got[i].kept == (not bad[i] and not far)
    assert not any(got[i].kept for i in range(100, 102))
    assert all(got[i].kept for i, _, k in texts if k in ("ru", "rare") and not bad[i])


def test_js_distance():
    p = np.array([[1.0, 0, 0], [0.5, 0.5, 0]])
    assert np.allclose(np.diag(rules.js_distance(p, p)), 0) and np.isclose(rules.js_distance(p[:1], np.array([[0.0, 1, 0]]))[0, 0], 1)


def chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    long = [x.count(" ") + 1 >= linededup.PASSAGE for x in lines]
    out, held = [], []
    for i, x in enumerate(lines):
        held.append(x)
        rolled = ((h[i - 1] if i else 0) * 31 + h[i]) % 4294967291 % 2 == 0
        if i + 1 == len(lines) or long[i] or long[i + 1] or rolled:
            t = "\n".join(held)
            out.append((t, long[i] or (len(held) > 1 and t.count(" ") + t.count("\n") + 1 >= linededup.LEAST)))
            held = []
    return out


def test_line_dedup(spark, docs, none):
    seen, want = set(), []
    for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        kept = []
        for t, may in chunks(r[1]):
            if not (may and t in seen):
                kept.append(t)
            if may:
                seen.add(t)
        want.append((r[0], None if r[1] is None else "\n".join(kept)))
    out = linededup.line_dedup(docs)
    # a column of the same name stays, the new one is named apart
    assert out.columns == [*docs.columns, "n_chunks_", "n_removed"] and out.where("n_chunks = 1").count() == docs.where("n_chunks = 1").count()
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=order) == sorted(want, key=order)
    assert linededup.line_dedup(none).count() == 0
    # names in use inside stay with their values
    odd = spark.createDataFrame([(1, f"{LONG}\nx", 5, 6, 7), (2, LONG, 8, 9, None)], "doc_id long, text string, __a int, __chunks int, __row int")
    for dedup in (linededup.line_dedup, linededup.passage_dedup):
        got = sorted(dedup(odd).collect(), key=lambda r: r.doc_id)
        assert [tuple(r)[2:5] for r in got] == [(5, 6, 7), (8, 9, None)] and got[0].text == f"{LONG}\nx" and got[1].text != LONG
    # rows alike in everything, or in id and text: one keeps what repeats
    twice = spark.createDataFrame([(1, LONG, i % 2) for i in range(6)] + [(2, LONG, 0)], "doc_id long, text string, other int").repartition(4)
    for dedup in (linededup.line_dedup, linededup.passage_dedup):
        got = sorted(len(r.text) for r in dedup(twice).collect())
        assert len(got) == 7 and got[-1] == len(LONG) and got[-2] < len(LONG) / 2


def without_repeats(texts):
    """Texts, in the order of their ids, without the lines of runs and chunks found before."""
    seen, want = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if lines[a].split() and lines[b].split() and sum(len(x.split()) for x in lines[a : b + 1]) >= linededup.PASSAGE]
        at = 0
        for c, may in chunks(t):
            runs += [(at, at + c.count("\n"))] if may else []
            at += c.count("\n") + 1
        lost = set()
        for a, b in sorted(set(runs)):
            x = "\n".join(lines[a : b + 1])
            if x in seen:
                lost |= set(range(a, b + 1))
            seen.add(x)
        want.append("\n".join(x for i, x in enumerate(lines) if i not in lost))
    return want


def test_passage_dedup_takes_whole_runs(spark, docs, none):
    """Against every run of lines of every text: what was found before goes, and all that line_dedup takes."""
    shared = [[prose(n, n) for _ in range(k)] for k, n in ((2, 30), (3, 18), (4, 15), (6, 10), (1, 55)) for _ in range(6)]
    shared.append([prose(20, 20), "", *(prose(9, 9) for _ in range(5)), " \t", prose(12, 12)])
    texts = []
    for _ in range(2):
        for p in shared:
            texts.append("\n".join([*(prose(9, 9) for _ in range(rng.randint(0, 4))), *p, *(prose(9, 9) for _ in range(rng.randint(0, 4)))]))
    texts += ["\n".join(shared[7] * 2), "\n".join(["a b c d e f g"] * 12), "\n" * 80, None, ""]
    want = without_repeats(texts)
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in linededup.passage_dedup(df).collect()}
    assert [got[i].text or "" for i in range(len(texts))] == want
    assert got[len(texts) - 2].text is None and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert all(not set(p) & set(got[len(shared) + i].text.split("\n")) - {"", " \t"} for i, p in enumerate(shared))
    assert any(set(p) & set(r.text.split("\n")) for p, r in zip(shared, linededup.line_dedup(df).where(f"doc_id >= {len(shared)} and doc_id < {2 * len(shared)}").orderBy("doc_id").collect()))
    out = linededup.passage_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and linededup.passage_dedup(none).count() == 0


def bench_rows(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "  "), (4, "Two words"), (10, ITEM), (10, prose(15))], "item_id long, text string")


def test_decontamination(spark, docs, none):
    bench = bench_rows(spark)
    windows = {}
    for item, text in (tuple(r) for r in bench.collect()):
        w = alnum(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = []
    for r in ROWS:
        w, hit, items = alnum(r[1]), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (got := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[got]
        want.append([r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)])
    got = decontam.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    clean = decontam.remove_contamination(docs, bench)
    assert decontam.contamination(clean, bench).where("contaminated").count() == 0
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(none, bench).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    """A benchmark larger than a broadcast gives what one block gives, shards of any size too."""
    bench = spark.createDataFrame([(i, prose(30) if i % 3 else TEXTS[18 + i][:400]) for i in range(30)] + [(50, ITEM), (51, None)], "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    want, clean = rows(decontam.contamination(docs, bench), *names), rows(decontam.remove_contamination(docs, bench), *docs.columns)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 1500)
    assert rows(decontam.contamination(docs, bench), *names) == want
    monkeypatch.setattr(decontam, "BLOCK", 2000)
    assert rows(decontam.contamination(docs, bench), *names) == want and sum(r[5] for r in want) > 5
    assert rows(decontam.remove_contamination(docs, bench), *docs.columns) == clean


def test_packed_bits():
    for n in (0, 1, 63, 64, 65, 500):
        bit = np.array([rng.randint(0, 1) for _ in range(n)], np.int64)
        packed, at = decontam.Bits(bit), np.arange(n + 1)
        assert packed.ones(at).tolist() == np.r_[0, np.cumsum(bit)].tolist() and packed.get(at[:-1]).tolist() == bit.tolist()


def test_fm_index():
    for _ in range(60):
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))] + [0]
        index = decontam.FMIndex(np.array(text))
        for _ in range(10):
            p = [rng.randint(1, 6) for _ in range(rng.randint(1, 4))]
            low, high = index.search(np.array([p + [0] * (5 - len(p))]), np.array([len(p)]))
            at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert at == [i for i in range(len(text)) if text[i : i + len(p)] == p]


def test_pii(docs, none):
    plain = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )

    def spans(text):
        return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(plain) for m in re.finditer(p, text) if ok(m[0]))

    for _ in range(5000):
        t = "".join(rng.choice("a@.@1234567890 +-()..a%5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == spans(t)
    want = sorted(([r[0], hashlib.sha256(pii._digest(spans(r[1] or "")).encode()).hexdigest()] for r in ROWS), key=repr)
    assert rows(pii.personal_data(docs), "doc_id", "base_sha256") == want
    assert pii.personal_data(none).count() == 0


def test_pii_learns_contexts(spark):
    seeds = [(i, f"x{i} please call me at +1 (234) 555-{1000 + i} today") for i in range(30)]
    keys = [(100 + i, f"say {i} token = '{hashlib.sha1(str(i).encode()).hexdigest()}' ends") for i in range(8)]
    mails = [(200 + i, f"{['a', 'b'][i % 2]} write to joe{i}@mail.example.com for more") for i in range(20)]
    others = [
        (99, "you can call me at 5551234567 today"), (98, "there were 5551234568 of them"), (97, "you may call me at home today"),
        (96, "its token = 'hunter2-and-more' ends"), (95, "digest " + "ab" * 20 + " of it"), (94, "just write to ann [at] mail [dot] org for more"), (93, None), (92, ""),
    ]
    found = pii.personal_data(spark.createDataFrame([*seeds, *keys, *mails, *others, others[0]], "doc_id long, text string").repartition(3)).collect()
    by = {r.doc_id: r.spans for r in found}
    assert len(found) == len(seeds) + len(keys) + len(mails) + len(others) + 1
    assert all(r.n_spans == len(r.spans.split(",")) * (r.spans != "") for r in found)
    assert by[99] == "phone:19:29" and by[98] == by[97] == by[95] == by[93] == by[92] == ""
    assert by[96] == "secret:13:29" and by[94] == "email:14:37"
    assert all(by[i].startswith("phone:") and "," not in by[i] for i in range(30))
    assert all(by[i].startswith("secret:") and "," not in by[i] for i in range(100, 108))
    assert all(by[i].startswith("email:11:") and "," not in by[i] for i in range(200, 220))


def test_pii_matcher_finds_all_slots():
    """Against every place of every text, for left, right and two-sided patterns."""
    words = ["call", "me", "at", "the", "id", "is", "=", ":", "x", "77", "a1", "ends", "İx"]
    for _ in range(300):
        low = pii.lowered(" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))))
        runs = [m.span() for m in re.finditer(r"\S+", low) if m[0] not in "=:"]
        names = {c for s, e in rng.sample(runs, min(2, len(runs))) for c in pii.contexts(low, s, e)}
        got = pii.Matcher({c: [0] for c in names})(low)
        want = {(s, e) for s, e in runs if set(pii.contexts(low, s, e)) & names}
        assert want <= set(got) | {(s, e) for s, e in runs if any(a <= s < b or a < e <= b for a, b in got)}
        assert all(set(c) & names for c in got.values())


def test_pii_scores(spark):
    """Rounds of the graph against plain loops."""
    edges = sorted({(rng.randrange(2), f"p{rng.randrange(6)}", f"s{rng.randrange(25)}") for _ in range(120)})
    seed = {(k, s): rng.random() < 0.6 for k, _, s in edges}
    score = {i: float(x) for i, x in seed.items()}
    for _ in range(pii.ROUNDS):
        good = {}
        for k, p in {e[:2] for e in edges}:
            held = [score[k, s] for k2, p2, s in edges if (k2, p2) == (k, p)]
            good[k, p] = sum(held) / (len(held) + pii.DAMP)
        score = {(k, s): 1.0 if seed[k, s] else 1 - np.prod([max(1 - good[k, p], 1e-9) for k2, p, s2 in edges if (k2, s2) == (k, s)]) for k, s in score}
    df = spark.createDataFrame([(k, p, s, seed[k, s]) for k, p, s in edges], "kind int, pattern string, surface string, seed boolean")
    got = {(r.kind, r.surface): r.score for r in pii.scored(df).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("size", [2048, 100])
def test_packing(docs, none, size):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = packing.pack(docs, size=size).collect()
    ids = [np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in ROWS]
    want = sorted(((r[0], i // size, i, len(x[i : i + size]), x[i : i + size].tobytes()) for r, x in zip(ROWS, ids) for i in range(0, len(x), size)), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=repr) == want
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= size
    first = packing.pack_rows(docs).first()
    assert 0 <= first.ids_crc32 < 2**32
    assert packing.pack(none).count() == 0


def test_packing_of_many_tasks(spark):
    """The count of sequences hardly grows with the count of tasks: against the least that the tokens allow."""
    pytest.importorskip("public_tokenizers")
    texts = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 250)))) for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = []
    for n in (1, 100):
        got = packing.pack_rows(df.repartition(n, "doc_id"))
        rows_ = got.collect()
        fill = {}
        for r in sorted(rows_, key=lambda r: (r.sequence_id, r.offset)):
            assert fill.get(r.sequence_id, 0) == r.offset
            fill[r.sequence_id] = r.offset + r.length
        least = -(-sum(r.length for r in rows_) // packing.SIZE)
        assert max(fill.values()) <= packing.SIZE and len({r.doc_id for r in rows_}) == 3000
        counts.append(len(fill) - least)
    assert counts[0] <= 2 and counts[1] <= 6


def test_other_tokenizers(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own, other = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert packing.is_known(own) and not packing.is_known(other)
    texts = ["Hello  wörld\n\n it's 42", "", "a" * 100]
    got = [x.tolist() for x in packing.tokens(other).many(pa.array(texts))]
    assert got == [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_equal_the_tokenizers(monkeypatch):
    """Odd strings, a few at a time, with little kept between calls."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    whole, mine = Tokenizer.from_file(path), packing.Tokens(path)
    monkeypatch.setattr(packing, "KEPT", 400)
    monkeypatch.setattr(packing, "LONG", 20)
    signs = "abcXYZäÖßéİıǅǆﬁ中文пр'’.,!?-_#$<|>@0189²½ªµº×÷\u0301\u00a0\u2003\u200b"
    for _ in range(120):
        texts = [" ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",", ".,", "'s"]) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        texts += [None, "", " \t\n", rng.choice(VOCABULARY).title() + ", " + rng.choice(VOCABULARY) * 9, "x" * 50 + " <|endoftext|> End."]
        got = [x.tolist() for x in mine.many(pa.array(texts, pa.string()))]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(mine.known) <= 400 and max(mine.known.values()) < len(mine.start) and max(map(len, mine.known)) <= 20


def test_sum_of_squares_rule():
    packer, gaps = packing.Packer(20), {}
    for _ in range(400):
        length = rng.randint(1, 20)
        at, offset = packer.place(length)
        gap = 20 - offset
        def total(change):
            now = dict(gaps)
            for g, k in change:
                if 0 < g < 20:
                    now[g] = now.get(g, 0) + k
            return sum(k * k for k in now.values())
        choices = {g: total([(g, -1), (g - length, 1)]) for g, k in gaps.items() if k and g >= length}
        if choices:
            assert gap in choices and choices[gap] == min(choices.values())
            gaps[gap] -= 1
        else:
            assert gap == 20
        if gap - length:
            gaps[gap - length] = gaps.get(gap - length, 0) + 1


def test_licences(spark, docs, none):
    text = licences.KNOWN["MIT"]
    odd = "# Copyright (c) 2020 Somebody\n\n" + text.lower().replace("noninfringement", "non-infringement").replace("sublicense", "sublicence").replace(". ", ".\n * ")
    df = spark.createDataFrame([(1, text), (2, odd), (3, text + " more"), (4, None), (5, " \n")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.license_scan(df).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    assert licences.license_scan(docs).where("license_id is not null").count() == 1
    near = spark.createDataFrame([(1, "licence licence Licence per cent per cent"), (2, "license LICENSE license percent percent")], "doc_id long, text string")
    assert licences.license_scan(near).select("canonical_sha256").distinct().count() == 1
    some = spark.createDataFrame([(i, None if i == 7 else "x") for i in range(len(licences.KNOWN) * 5)], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licences.license_scan(licences.variants(some)).collect()}
    assert found == {i: sorted(licences.KNOWN)[i % len(licences.KNOWN)] if i % 5 < 3 else None for i in found} and len(found) == some.count()
    given = spark.createDataFrame([("b", "x y", None), ("a", "X, y.", None), ("c", None, hashlib.sha256(b"q r").hexdigest()), ("d", " ", None)], "license_id string, text string, canonical_sha256 string")
    mine = spark.createDataFrame([(1, "x-y"), (2, "Q\nR"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.license_scan(mine, given).collect()} == {1: "a", 2: "c", 3: None}
    whole = pathlib.Path("/usr/share/common-licenses")
    if whole.is_dir():
        texts = [(1, (whole / "Apache-2.0").read_text()), (2, (whole / "GPL-3").read_text().upper()), (3, "Copyright 2020 me\n" + (whole / "MPL-2.0").read_text())]
        assert {r.doc_id: r.license_id for r in licences.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {1: "Apache-2.0", 2: "GPL-3.0", 3: "MPL-2.0"}
    assert licences.license_scan(none).count() == 0


def test_classifier(spark, none):
    good = [(i, prose(rng.randint(60, 200))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "***" for w in prose(rng.randint(60, 200)).split())) for i in range(300)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in (*good, *bad)] + [(None, 1, 0), (7000, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = gam.train(docs, labels)
    out = {r.doc_id: (r.score, r.predicted) for r in gam.quality_scores(docs, model).collect()}
    held = [i for i, _ in (*good, *bad) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i][1] == (i < 1000) for i in held]) > 0.98
    assert all(0 <= s <= 1 for s, _ in out.values()) and len(out) == 602
    kept = gam.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(p for _, p in out.values())
    flat = gam.train(docs, labels.limit(0))
    assert flat.score(np.zeros((1, len(gam.FEATURES))))[0] == pytest.approx(0.5)
    assert gam.quality_scores(none, model).count() == 0


def test_pair_tables_learn_an_interaction():
    x = np.random.default_rng(1).random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_class_counts():
    assert dict(zip(textstats.CLASSES, textstats.class_counts("aB1 \n.,!#é~".encode()).tolist())) == {"lower": 1, "upper": 1, "digit": 1, "blank": 1, "newline": 1, "stop": 2, "mark": 1, "symbol": 1, "other": 1, "beyond": 1}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert out.select("doc_id").distinct().count() <= docs.count()


def test_scores_are_sums_of_lookups():
    """The classifier's vectorised score against one row and one table at a time."""
    r = np.random.default_rng(3)
    x = r.random((500, len(gam.FEATURES)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.8).astype(float)
    model = gam.fit(x, y)
    assert model.pairs
    for row, got in zip(x[:60], model.score(x[:60])):
        total = model.intercept
        for j, edges in enumerate(model.edges):
            total += model.tables[j][sum(e <= row[j] for e in edges)]
        for (i, j), grid in zip(model.pairs, model.pair_tables):
            total += grid[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_pipeline_by_plain_loops(spark, tmp_path):
    """Each stage, on what the one before it kept, against a plain version; extra columns come through."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    shared = prose(60, 20)
    texts = [prose(rng.randint(60, 260), 60) for _ in range(70)]
    texts += [texts[3], texts[3], texts[5].replace(texts[5].split()[9], "changed"), f"{prose(70, 30)}\n{shared}\n{prose(40, 20)}", f"{prose(80, 25)}\n{shared}"]
    texts += [f"{prose(50, 50)} {ITEM} {prose(30, 30)}" for _ in range(3)]
    texts += [" ".join(w + "***" for w in prose(rng.randint(60, 200)).split()) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 7, i) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    labels = [(i, int("***" not in t), 0) for i, t in enumerate(texts) if t]
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", bench_rows(spark))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        now.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        out.append(now)
    held = [{r.doc_id: r for r in df.collect()} for df in out[:4]]
    assert all(df.columns == docs.columns for df in out[:4]) and all(r.n_chunks == 7 and r.label == i for h in held for i, r in h.items())
    model = gam.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    score = {i: model.score(np.array([gam.features(t.encode() if t else None)]))[0] for i, t in enumerate(texts)}
    assert set(held[0]) == {i for i, s in score.items() if s >= gam.THRESHOLD} and {i for i, t in enumerate(texts) if t and "***" in t}.isdisjoint(held[0])
    order = sorted(held[0])
    assert [held[1][i].text or "" for i in order] == without_repeats([held[0][i].text for i in order])
    pairs, nodes = near_pairs([held[1][i].text or "" for i in order])
    root = united([p[:2] for p in pairs], nodes)
    first = {}
    for i in order:
        first.setdefault(root[simhash.content_prints((held[1][i].text or "").encode())[0]], i)
    assert set(held[2]) == set(first.values()) and all(held[2][i].text == held[1][i].text for i in held[2])
    windows = {tuple(w[i : i + 10]) for r in bench_rows(spark).collect() for w in [alnum(r.text)] for i in range(max(1, len(w) - 9)) if w}
    for i, r in held[3].items():
        before, hit = alnum(held[2][i].text), set()
        for size in {len(x) for x in windows}:
            for at in range(len(before) - size + 1):
                if tuple(before[at : at + size]) in windows:
                    hit.update(range(at, at + size))
        assert alnum(r.text) == [w for k, w in enumerate(before) if k not in hit] and r.n_chars == (None if r.text is None else len(r.text))
    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {i: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for i, r in held[3].items()}
    want = sorted((i, n, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes())) for i, x in ids.items() for n, at in enumerate(range(0, len(x), 2048)))
    packed = out[4].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(len(x) for x in ids.values()) // 2048) + 1
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again) == want
