"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, decontaminate, lines, minhash, packing, quality, repeats, secrets, urls, warc
from sparkloom.llm.queries import byte_bpe_path
from sparkloom.llm.rindex import RunLengthIndex

#: Extra columns whose names the operators use inside or in results.
EXTRA = "h int, n int, at int, key int, row int, leaf int, n_lines int, rejected int, spans int"
RNG = np.random.default_rng(4)
WORDS = ["".join(RNG.choice(list("aeioustrn"), 4)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n)) + "."


def documents():
    """(doc_id, text) with copies, near copies, shared passages, repeated rows, nulls, empty and very long texts."""
    base = [prose(60, i) for i in range(12)]
    lines_of = ["\n".join(prose(9, 100 * i + j) for j in range(6)) for i in range(6)]
    passage = prose(70, 999)
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(lines_of)]
    rows += [(30, base[3]), (31, base[3]), (32, base[4].replace("a", "A", 3) + " tail"), (33, base[4] + " other tail"),
             (34, base[5][:-40]), (35, lines_of[0] + "\n\n" + lines_of[1]), (36, "\n".join(lines_of[2].split("\n")[1:5])),
             (37, "\n".join(["same line"] * 7)), (38, "x " + passage + " y"), (39, passage), (40, base[6] + "\n" + passage),
             (41, "é" * 30 + "ü" * 30), (42, "ab" + "é" * 30 + "ü" * 29), (43, "short"), (44, "short"), (45, ""), (46, None), (47, " \n\t "),
             (48, "z" * 400), (49, "z" * 90), (None, base[3]), (None, None), (50, prose(6000, 5)), (51, prose(6000, 5) + " more")]
    return rows + [(7, base[7]), (52, "a b c"), (53, "A  b\tc")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 3 else None, f"src{(i or 0) % 4}" if i != 5 else None, len(t or ""), *range(9)) for i, t in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def brute_lines(run=3):
    seen, order = {}, sorted({(i, t) for i, t in documents() if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = {}
    for i, t in order:
        all_lines = t.split("\n")
        full = [k for k, x in enumerate(all_lines) if x.strip(" \t\x0b\x0c\r")]
        norm = [all_lines[k].strip(" \t\x0b\x0c\r").lower() for k in full]
        gone = set()
        for p in range(len(norm) - run + 1):
            w = tuple(norm[p:p + run])
            if w in seen:
                gone |= set(range(p, p + run))
            seen.setdefault(w, (i, p))
        if i is None:
            gone = set()
        cut = {full[g] for g in gone}
        out[(i, t)] = (len(norm), len(gone), "\n".join(x for k, x in enumerate(all_lines) if k not in cut))
    return out


def test_line_dedup(docs, nothing):
    want = brute_lines()
    got = lines.dedup(docs).collect()
    assert len(got) == len(documents())
    before = Counter(documents())
    for r in got:
        source = [(i, t) for i, t in before if i == r.doc_id and (t is None) == (r.text is None) and (t is None or want[(i, t)] == (r.n_lines, r.n_removed, r.text))]
        assert source, r
    assert sum(r.n_removed for r in got) > 20 and next(r for r in got if r.doc_id == 37).text == "same line"
    dropped = lines.dedup(docs, drop_emptied=True)
    assert 36 not in {r.doc_id for r in dropped.collect()} and {45, 47, 43} <= {r.doc_id for r in dropped.collect()}
    assert lines.dedup(nothing).count() == 0


def brute_links(percent=85, width=5):
    sets = {}
    for i, t in documents():
        words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(width, len(words))
        if i is not None:
            sets.setdefault((i, t), {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(keys[a]), find(keys[b])
                root[max(u, v, key=lambda k: k[0])] = min(u, v, key=lambda k: k[0])
    return {k[0]: (len(sets[k]), find(k)[0]) for k in keys}


def test_near_duplicates(docs, nothing):
    want = brute_links()
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(documents())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 31").count() == 0 and kept.where("doc_id = 7").count() == 2


def test_large_group_of_near_copies(spark):
    """Copies that are near the middle one but not each other still form one component, without all pairs."""
    words = prose(300, 1).split()
    rows = [(1000, " ".join(words))]
    for i in range(120):
        some, r = list(words), np.random.default_rng(i)
        for k in r.choice(290, 4, replace=False):
            some[k] = f"w{i}x{k}"
        rows.append((i, " ".join(some)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("size", [1, 40, 1500])
def test_sketches_never_differ_by_more_than_the_sets(spark, size):
    """Also for sets larger than the sketch, repeated ids and empty sets."""
    r = np.random.default_rng(size)
    sets = [sorted(set(r.integers(-(1 << 63), 1 << 63 - 1, size).tolist()))]
    for part in (0.02, 0.2, 0.9):
        sets.append(sorted({int(x) if r.random() > part else int(x) ^ 12345 for x in sets[0]}))
    sets += [[], sets[0]]
    rows = spark.createDataFrame([(min(i, 4), s) for i, s in enumerate(sets)], "doc_id long, shingles array<long>").coalesce(1)
    got = minhash.sketches(rows).collect()
    assert [len(g.sketch) for g in got] == [minhash.SKETCH_BITS // 64] * len(sets)
    for x, a in zip(got, sets):
        for y, b in zip(got, sets):
            apart = sum(((p ^ q) % (1 << 64)).bit_count() for p, q in zip(x.sketch, y.sketch))
            assert apart <= len(set(a) ^ set(b)) and (apart - len(set(a) ^ set(b))) % 2 == 0


def test_near_but_not_near_enough_makes_no_pairs(spark):
    """Copies just below the threshold share rare shingles, but the sketches keep their pairs from becoming rows."""
    words = prose(150, 77).split()
    rows = []
    for i in range(150):
        some, r = list(words), np.random.default_rng(500 + i)
        for k in r.choice([7, 30, 53, 76, 99, 122, 140], 4, replace=False):
            some[k] = f"v{k}x{r.integers(3)}"
        rows.append((i, " ".join(some)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash.shingles(docs)
    held = {r.doc_id: set(r.shingles) for r in sets.collect()}
    want = {(a, b) for a in held for b in held if a < b and 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])}
    active = sets.select(F.lit(1).alias("key"), F.col("doc_id").alias("doc"), F.size("shingles").cast("long").alias("n"), F.col("doc_id").alias("label"))
    got = {(r.p, r.x) for r in minhash._prefix_pairs(active, sets, 85).collect()}
    assert want and want <= got and len(got) < len(want) + 0.1 * 150 * 149 / 2


def items():
    return [(1, prose(70, 999)), (2, prose(60, 2)), (3, "a b c"), (4, ""), (5, None), (6, "short"), (None, prose(30, 8)), (7, prose(60, 2))]


def brute_decontamination(width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for i, t in items():
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = {}
    for i, t in documents():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out[(i, t)] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("part_bytes", [16 << 20, 300])
def test_decontamination(spark, docs, nothing, part_bytes):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    want = Counter((i, w[0], tuple(w[1]), tuple(w[2])) for (i, t), w in brute_decontamination().items() for _ in range(Counter(documents())[(i, t)]))
    got = Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r["items"])) for r in decontaminate.scan(docs, bench, part_bytes=part_bytes).collect())
    assert got == want
    clean = decontaminate.remove(docs, bench, part_bytes=part_bytes)
    assert clean.columns == docs.columns and all(not r.hit_words for r in decontaminate.scan(clean, bench).collect())
    assert {r.doc_id for r in decontaminate.remove(docs, bench, how="documents").collect()} == {i for (i, _), w in brute_decontamination().items() if not w[1]}
    assert decontaminate.scan(nothing, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0


def test_a_large_benchmark_is_joined_not_broadcast(spark, docs, monkeypatch):
    """Above the size no window set is made; a passage in most rows is dealt over the salts."""
    monkeypatch.setattr(decontaminate, "WindowSet", None)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    hot = spark.createDataFrame([(i % 50, f"q{i} " + prose(70, 999), i) for i in range(300)], "doc_id long, text string, row int")
    found = decontaminate.scan(hot, bench, part_bytes=300)
    assert found.count() == 300 and found.where("size(hit_words) = 70 AND items = array('1')").count() == 300
    cut = decontaminate.remove(hot, bench, part_bytes=300)
    assert cut.columns == hot.columns and sorted(r.text.split()[0] for r in cut.collect()) == sorted(f"q{i}" for i in range(300))
    assert decontaminate.remove(hot, bench, how="documents", part_bytes=300).count() == 0
    with pytest.raises(TypeError):
        decontaminate.scan(hot, bench)


@pytest.mark.parametrize("part_bytes", [16 << 20, 300])
def test_cutting_uncovers_no_window_on_either_path(spark, part_bytes):
    inner, outer = prose(10, 50), prose(20, 51)
    w = outer.split()
    docs = spark.createDataFrame([(1, " ".join(w[:10]) + " " + inner + " " + " ".join(w[10:]) + " end"), (2, None), (3, inner)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, inner), (2, outer)], "item_id long, text string")
    left = decontaminate.remove(docs, bench, part_bytes=part_bytes)
    assert {r.doc_id for r in left.collect()} == {1, 2} and all(not r.hit_words for r in decontaminate.scan(left, bench).collect())


def test_cutting_uncovers_no_window(spark):
    inner, outer = prose(10, 50), prose(20, 51)
    w = outer.split()
    docs = spark.createDataFrame([(1, " ".join(w[:10]) + " " + inner + " " + " ".join(w[10:]) + " end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, inner), (2, outer)], "item_id long, text string")
    assert [r.text.split() for r in decontaminate.remove(docs, bench).collect()] == [[".", "end"]] or \
        all(not r.hit_words for r in decontaminate.scan(decontaminate.remove(docs, bench), bench).collect())


def test_repeats(docs, nothing):
    texts = {(i, t) for i, t in documents() if i is not None and t is not None}
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    want = Counter()
    for i, t in documents():
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if i is not None and first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    got = repeats.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_of_a_hot_anchor(docs, monkeypatch):
    """The way for anchors with too many contexts gives the same marks."""
    whole = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs).collect())
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 1)
    assert Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs).collect()) == whole


@pytest.mark.parametrize("seed", range(6))
def test_run_length_index(seed):
    r = np.random.default_rng(seed)
    base = bytes(r.integers(97, 100, 400, dtype=np.uint8))
    texts = [base[a:a + int(r.integers(50, 110))] for a in r.integers(0, 280, 50)]
    ids = r.integers(0, 30, 50)
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    index = RunLengthIndex(data, ends, ids, 50)
    least = {}
    for t, d in zip(texts, ids.tolist()):
        for p in range(len(t) - 49):
            least[t[p:p + 50]] = min(d, least.get(t[p:p + 50], 99))
    want = [least[t[p:p + 50]] if p + 50 <= len(t) else 99 for t in texts for p in range(len(t))]
    assert index.least_documents(data, ends, 99).tolist() == want and index.runs < index.rows / 2
    foreign = np.frombuffer(b"q" * 30 + base[:60], np.uint8)
    assert set(index.least_documents(foreign, np.array([90]), 99)[:30].tolist()) == {99}


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    got = packing.pack_documents(docs, byte_bpe_path(), end_id=1, length=256, group_pieces=40).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in documents())
    whole = Counter()
    for (i, n), pieces in by_doc.items():
        starts = Counter(r.start for r in pieces)
        ids = [x for s in sorted(starts) for x in next(r.ids for r in pieces if r.start == s)]
        if i not in (None,) and sum(1 for k in want if k[0] == i) == 1:
            assert len(ids) == n and (i, tuple(ids)) in want and set(starts.values()) == {want[(i, tuple(ids))]}
            whole[(i, tuple(ids))] += 1
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 256
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    padding = sum(256 - sum(r.length for r in rows) for rows in by_sequence.values())
    assert padding < 0.1 * 256 * len(by_sequence)
    assert packing.pack_documents(nothing, byte_bpe_path()).count() == 0


def test_first_fit_decreasing():
    sizes = np.sort(RNG.integers(1, 100, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for size, b, o in zip(sizes, bins, offsets):
        first = next((k for k, f in enumerate(free) if f >= size), len(free))
        if first == len(free):
            free.append(100)
        assert (b, o) == (first, 100 - free[first])
        free[first] -= size


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "a \n b\n\n", "it's  'll \t x", "1 2  3.5\r\n x\x1fy", "é中 文 z", "a<|endoftext|> b  <|endoftext|>"])
def test_chunked_ids_are_the_tokenizers(text):
    e = packing.encoder(byte_bpe_path())
    assert e.encode([text, text])[1].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def secret_texts():
    token = "Zk9" + "aB3dE5fG7hJ9kL1mN2pQ"
    return [(1, "password = 'hunter22' and token: abc", "a"), (2, "AKIA" + "B2" * 9 + " " + "0a" * 14, "a"), (3, f"x {token} y", "a"),
            (4, "copied Ex4mpleEx4mpleEx4mple1 here", "a"), (5, "copied Ex4mpleEx4mpleEx4mple1 there", "b"), (6, None, "b"), (7, "", None),
            (8, "ünï API_KEY=\"Zz11Zz22Zz33\" password: token: secret:qwertyui", None), (8, "ünï API_KEY=\"Zz11Zz22Zz33\" password: token: secret:qwertyui", None),
            (9, "w " * 20000 + "api-key apikey=aaaaaa", "c")]


def test_secrets(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in secret_texts()], "doc_id long, text string, source string, base int, tokens int")
    got = secrets.scan(df).collect()
    assert len(got) == len(secret_texts())
    for r in got:
        text = next(t or "" for i, t, _ in secret_texts() if i == r.doc_id)
        want = []
        for rank, (kind, pattern, group, least) in enumerate(secrets.BASE_KINDS):
            want += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
        assert [(s.start, s["rank"], s.kind, s.end) for s in r.spans if s.kind != "owned"] == sorted(want), r
    owned = {r.doc_id for r in got for s in r.spans if s.kind == "owned"}
    assert owned == {3} and secrets.scan(df.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert masked[3] == "x [secret] y" and masked[6] == "" and "hunter22" not in masked[1]


def test_a_template_of_one_owner_is_no_live_secret(spark):
    """Repositories count as well as owners: one owner with a string in many of them copied an example."""
    few, many = "Ab1" + "x" * 20, "Cd2" + "y" * 20
    rows = [(i, f"key {many}", "one") for i in range(11)] + [(i, f"key {few}", "one") for i in range(50, 60)] * 2
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id >= 50, len(r.spans)) for r in got} == {(False, 0), (True, 1)} and len(got) == 31
    wide = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_live_repositories=11)
    assert wide.where("size(spans) = 1").count() == 31


def test_url_rules_and_features(spark):
    rows = [(1, "http://a.example.net/en/x"), (2, "https://Example.NET/de"), (3, "x"), (4, None), (5, "http://notexample.com/de/1"), (6, "http://m.example.com/de/1?q=/x"),
            (7, "ftp://example.org/fr/"), (8, "http://example.net"), (9, "http://example.com/de/#f"), (9, "http://example.com/de/#f"), (10, "://h"), (11, "http://net/?" + "a" * 9000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(*r, 3, 4) for r in rows], "page_id long, url string, host int, action int")).collect()}
    assert [(got[i].rule, got[i].host, got[i].path) for i in range(1, 12)] == [
        ("example.net/en/", "a.example.net", "/en/x"), ("net/", "example.net", "/de"), (None, "", ""), (None, "", ""), (None, "notexample.com", "/de/1"),
        ("example.com/de/", "m.example.com", "/de/1"), ("org/fr/", "example.org", "/fr/"), (None, "example.net", ""), ("example.com/de/", "example.com", "/de/"),
        (None, "h", ""), ("net/", "net", "/")]
    assert [got[i].verdict for i in (1, 2, 6, 7)] == ["allow", "block", "block", "allow"] and all(r.verdict in ("allow", "block") for r in got.values())
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a.net/x"), (2, "q")], "page_id long, url string")).collect()} == {"block"}
    text = spark.createDataFrame([("aab.c",), ("",)], "t string").select(urls.entropy(F.col("t")).alias("e")).collect()
    assert abs(text[0].e - (0.4 * np.log2(2.5) + 0.6 * np.log2(5))) < 1e-9 and text[1].e == 0


def test_url_trees_on_held_out_urls(spark):
    """Trees trained on rule-labelled URLs tell held-out ones whose hosts look alike."""
    rows = [(i, f"http://{'ads-x' if i % 2 else 'news'}{i % 37}.example.{'net' if i % 2 else 'org'}/{'p' if i % 2 else 'fr'}/{i}" + ("?a=1&b=2" if i % 2 else "")) for i in range(400)]
    rules = [("block", "net", "/"), ("allow", "org", "/fr/")]
    held = [(1000 + i, u.replace(".net/", ".net:80/").replace("/fr/", "/fr2/")) for i, u in rows[:100]]
    got = urls.judge(spark.createDataFrame(rows + held, "page_id long, url string"), rules=rules).where("page_id >= 1000").collect()
    assert all(r.rule is None for r in got) and np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in got]) > 0.9


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(12, 16))[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(3000)]
    bad = [(9000, None, 1), (9050, [0.0] * 16, 1), (9100, [1.0] * 15 + [None], 1), (9150, [float("nan")] * 16, 1), (9200, [float("inf")] + [1.0] * 15, 1),
           (None, rows[0][1], 1), (9250, [1.0, 2.0], 1), rows[0], rows[150]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, leaf int")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=5, leaf_rows=60).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    found, by = 0, {}
    for row in got:
        by.setdefault(row.query_id, []).append(row)
        assert abs(row.score - unit[row.query_id] @ unit[row.vec_id]) < 1e-9 and row.vec_id != row.query_id
    assert sorted(by) == list(range(0, 3000, 50))
    for q, near in by.items():
        near.sort(key=lambda z: z["rank"])
        assert [z["rank"] for z in near] == [1, 2, 3, 4, 5] and [(-z.score, z.vec_id) for z in near] == sorted((-z.score, z.vec_id) for z in near)
        s = unit @ unit[q]
        s[q] = -9
        s[s > 1 - 1e-12] = 1
        found += len({z.vec_id for z in near} & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert found / (5 * len(by)) >= 0.9
    assert [z.vec_id for z in by[150]] == [100, 101, 102, 103, 104] and [z.vec_id for z in by[100]] == [101, 102, 103, 104, 105]
    few = ann.search(df.where("vec_id IN (0, 1, 50)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((z.query_id, z.vec_id) for z in few) == [(0, 1), (0, 50), (50, 0), (50, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0 and ann.search(df.where("vec_id > 8999"), F.col("vec_id") % 50 == 0).count() == 0


def test_queries_are_sent_to_bins_not_leaves(spark, monkeypatch):
    """A query vector travels once for each bin of leaves and not for every leaf, in batches of bounded size."""
    r = np.random.default_rng(7)
    x = r.normal(size=(9000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    kept, plain = {}, ann.keep
    monkeypatch.setattr(ann, "keep", lambda df, name: kept.setdefault(name, plain(df, name)))
    monkeypatch.setattr(ann, "ROUTES", 7)
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=5, leaf_rows=20).collect()
    leaves = kept["ann-leaves"].select("leaf").distinct().count()
    assert leaves > 200 and kept["ann-routes"].count() <= 180 * 4
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit[::50] @ unit.T
    s[np.arange(180), np.arange(0, 9000, 50)] = -9
    true = {(50 * q, int(v)) for q, row in enumerate(s) for v in np.argsort(-row)[:5]}
    assert len(got) == 900 and len(true & {(z.query_id, z.vec_id) for z in got}) >= 810
    sizes = {leaf: n for leaf, n in enumerate([5, 9000, 1, 4000, 90, 90, 4096])}
    assert [ann.bins(sizes)[leaf] for leaf in sorted(sizes)] == [0, 1, 2, 2, 2, 3, 4]


def test_quality(spark):
    def text(i):
        body = prose(40, 3000 + i)
        return body.replace(" ", "### ") if i % 10 == 0 else body + " vilewordx" if i % 10 == 1 else body

    rows = [(i, text(i), "en", f"s{i % 7}", 1) for i in range(600)] + [(700, None, None, None, 1), (701, "", "en", None, 1), (1, text(1), "en", "s1", 1), (None, prose(30, 1), "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rejected int")
    labels = [(i, int(i % 10 != 0), int(i % 10 == 1)) for i in range(300)] + [(3, None, 0), (None, 1, 1), (5, 1, None), (2, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model)
    assert got.count() == len(rows)
    held = {r.doc_id: r for r in got.collect() if r.doc_id is not None and 300 <= r.doc_id < 600}
    assert np.mean([r.rejected == (i % 10 < 2) for i, r in held.items()]) > 0.97
    assert all(r.rejected == (i % 10 < 2) for i, r in held.items() if i % 10 > 1)
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    blank = quality.judge(docs, quality.fit(docs, labels.limit(0)))
    assert blank.where("rejected").count() == 0 and quality.judge(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels, wrong", [([(1, 0, 0)], ()), ([(i, 1, 0) for i in range(9)], ()), ([(i, 0, 1) for i in range(9)], ()),
                                           ([(i, int(i % 10 != 0), 0) for i in range(200)], ("low_quality",))])
def test_quality_rejects_nothing_for_a_fault_without_both_labels(spark, labels, wrong):
    """No label, one label and one kind of label only leave every document; one fitted fault acts alone."""
    rows = [(i, prose(40, 3000 + i).replace(" ", "### ") if i % 10 == 0 else prose(40, 3000 + i), "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [f for f, ok in zip(quality.FAULTS, model.fitted) if ok] == list(wrong)
    gone = {r.doc_id for r in quality.judge(docs, model).where("rejected").collect()}
    assert gone == ({i for i in range(200) if i % 10 == 0} if wrong else set())


def test_clashing_helper_names(spark):
    """Columns named like helpers inside the operators come back as they were."""
    extra = "__at string, at string, _at string, h string, id string, hash string, row string, host string, path string, __n string, __host string, __low_quality string"
    n = len(extra.split(","))
    rows = [(i, "\n".join(prose(9, j) for j in range(i, i + 4)), "en", "s", *[f"v{i}"] * n) for i in range(6)] + [(9, "z" * 3_000_000, None, None, *["v9"] * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + extra)
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int"))
    for out in (lines.dedup(docs), quality.judge(docs, model)):
        got = out.collect()
        assert out.columns[:len(docs.columns)] == docs.columns and len(got) == len(rows)
        assert all(r[c.split()[0]] == f"v{r.doc_id}" for r in got for c in extra.split(", "))


def test_redact_cuts_each_row_by_its_own_text(spark):
    rows = [(1, "password=abcdefg", "a"), (1, "no", "a"), (None, "token=abcdefgh", "b"), (None, None, "b"), (1, "password=abcdefg", "a")]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "[secret]"), (1, "no"), (None, "[secret]"), (None, ""), (1, "[secret]")])


def test_sparse_sites_shrink(spark):
    """One faulty document at a small site says little, many at a large one say much."""
    rows = [("small", "p", 3.0)] + [("bad", "p", 3.0)] * 300 + [("good", "p", -3.0)] * 300
    scored = spark.createDataFrame(rows, "host string, path string, __low_quality double").withColumn("__toxic", F.lit(-5.0))
    got = {r.host: r for r in quality.site_posteriors(scored, np.array([0.2, 0.1])).collect()}
    assert got["good"].m_low_quality < got["small"].m_low_quality < got["bad"].m_low_quality
    assert abs(got["small"].m_low_quality - 0.5) < 0.2


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900
    rows = [(i, f"http://x/{i}", big if i % 3 == 0 else f"page {i} " * 200, 1) for i in range(40)]
    rows += [(50, None, None, 1), (51, "http://a\r\nb", "", 1), (52, "u", "small", 1), (53, "u", "small", 1), (None, "u", big, 1), (3, "http://x/3", big, 1), (54, "v", "q" * 700_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        index = warc.write_archives(df, frame_bytes=4000, bundle_bytes=20_000)
        assert index.count() == len(rows) and index.select("bundle").distinct().count() > 3
    spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows) and index.select("bundle").distinct().count() > 3
    html = {str(i) if i is not None else "": h or "" for i, _, h, _ in rows}
    for r in got:
        full = html[r.record_id].encode()
        assert (r.payload_length, r.payload_digest) == (len(full), hashlib.sha1(full).hexdigest())
        revisit = full == big.encode() and r.record_id != "39"
        assert (r.record_type, r.refers_to) == (("revisit", "39") if revisit else ("response", None)) and (r.payload is None if revisit else bytes(r.payload) == full)
    some = warc.fetch_records(index.where("record_id IN ('4', '54', '6')")).collect()
    assert sorted((r.record_id, r.record_type) for r in some) == [("4", "response"), ("54", "response"), ("6", "revisit")]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    import zstandard
    with open(index.first().bundle, "rb") as f:  # any decoder reads the bundle as one stream and skips the seek table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(8) == b"WARC/1.1"


def brute_passages(texts, run=3, words=50):
    """Kept texts where every window of ``run`` lines, or of fewer lines with ``words`` words, counts."""
    seen, out = set(), {}
    for i, t in sorted(texts):
        rows, gone, mine = t.split("\n"), set(), set()
        for p in range(len(rows)):
            for n in range(1, min(run, len(rows) - p) + 1):
                w = tuple(x.strip().lower() for x in rows[p:p + n])
                if n == run or sum(len(x.split()) for x in w) >= words:
                    if w in seen or w in mine:
                        gone |= set(range(p, p + n))
                    mine.add(w)
        seen |= mine
        out[i] = "\n".join(x for k, x in enumerate(rows) if k not in gone)
    return out


def test_long_passages_in_one_or_two_lines(spark):
    one, a, b, c = prose(70, 1), prose(40, 2), prose(15, 3), prose(50, 4)
    texts = [(1, "head\n" + one + "\n" + a + "\n" + b), (2, one), (3, "x\n" + one.upper() + "\ny"), (4, a + "\n" + b), (5, "z\n" + a + "\n" + b + "\nend"),
             (6, a), (7, b + "\n" + a), (8, c + "\nshort"), (9, c + "\nshort\nq"), (10, prose(49, 5)), (11, prose(49, 5)), (12, c + "\n" + one + "\n" + b),
             (13, "k1\nk2\n" + c), (14, "k1\nk2\n" + c), (15, one + "\n" + one)]
    r = np.random.default_rng(8)
    pool = [prose(int(n), 300 + k) for k, n in enumerate(r.integers(1, 60, 12))]
    texts += [(100 + k, "\n".join(r.choice(pool, int(r.integers(1, 7))))) for k in range(60)]
    want = brute_passages(texts)
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string"), words=50).collect()}
    assert got == want
    assert got[2] == got[4] == "" and got[3] == "x\ny" and got[5] == "z\nend" and got[6] == a and got[9] == "q" and got[14] == "" and got[11]


def test_anchors_shared_inside_batches_are_spread(spark):
    """Copies in every batch: their anchors do not all go to the group of the least hashes."""
    rows = [(i, prose(3000, i // 2)) for i in range(32)]
    packed = repeats._packed(spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "doc_id long, text string"), 50, 16, 16)
    known = Counter(r.bucket for r in packed.where("size(known_h) > 0").select("bucket").collect())
    assert sum(known.values()) == 16 and len(known) > 4 and max(known.values()) <= 6
    pairs = {(r.doc_id, r.h) for r in repeats._shared_anchors(packed).collect()}
    of = lambda i: {h for d, h in pairs if d == i}
    assert all(of(i) == of(i + 1) and len(of(i)) > 500 for i in range(0, 32, 2))
