"""The training-data operators against brute force on small tables, with nulls, empty texts, ties and repeated rows."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamgauge.llm import decontam, license_scan, line_dedup, packing, pii, quality, setjoin, token_store, tokens, url_filter, warc
from streamgauge.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, extra int"
ODD = [(None, None, 1), (3, None, 1), (3, "b", 1), (3, "b", 1), (1, "", 1)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name):
    e, rng = tokens.encoder(kind, tokens.public(name)), random.Random(1)
    odd = ["", "  ", "a  b", " lead", "trail ", "x\n\ny", "a\tb", "\n", "don't", "\u0130stanbul \u03a3", "a\x1cb", "<|endoftext|> hi", "a\u00a0b", "end.\n\n  z"]
    odd += ["".join(rng.choice("ab \n\ts'1!.\u0301\u03a3\u3000<|") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for x in odd:
        assert e.encode(x) == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), ascii(x)


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_added_tokens_as_in_a_fresh_tokenizer(kind, name):
    from tokenizers import Tokenizer

    e, fresh, rng = tokens.encoder(kind, tokens.public(name)), Tokenizer.from_file(tokens.public(name)), random.Random(9)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "a", " ", "\n", "  ", "\u0130", "\u00a0", "don't", "\x1c", "12"]
    odd = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", " <|endoftext|>  <|endoftext|>\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for x in odd:
        assert e.encode(x) == np.array(fresh.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), ascii(x)


def test_token_store_and_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    d = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c <|startoftext|> d")], "doc_id long, text string")
    ids = {n: [len(Tokenizer.from_file(tokens.public(n)).encode(x, add_special_tokens=False).ids) + 1 for x in ("a <|endoftext|> b", "c <|startoftext|> d")] for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    got = {r.key: (r.start, r.n_tokens) for r in token_store.read_back(spark, token_store.write(d)).collect()}
    first, second = ids["byte_bpe_50k.json"]
    assert got == {1: (0, first), 2: (first, second)}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(d).collect()} == {1: ids["word_bpe_49k.json"][0], 2: ids["word_bpe_49k.json"][1]}


def test_token_store_round_trip(spark):
    d = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(ODD, DOC).select("doc_id", "text").where("doc_id is null"))
    m = token_store.write(d)
    got = token_store.read_back(spark, m).collect()
    t = tokens.encoder("byte", tokens.public("byte_bpe_50k.json")).tokenizer
    start = 0
    for row, r in zip(sorted(d.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id), sorted(got, key=lambda r: r.start)):
        ids = np.array([*t.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.key, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(token_store.fetch(m, [5, 10**9])[5]) == 1 and 10**9 not in token_store.fetch(m, [10**9])
    assert token_store.read_back(spark, token_store.write(d.limit(0))).count() == 0


def test_token_store_look_ups_read_little(spark):
    rows = [(i * i - 500, f"text {i}") for i in range(300)] + [(7, "a"), (7, "b"), (7, "b"), (None, "c"), (8, None)]
    m = token_store.write(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int"))
    t = tokens.encoder("byte", tokens.public("byte_bpe_50k.json")).tokenizer
    want = {}
    for k, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], str(r[1]))):
        want.setdefault(k, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    got = token_store.fetch(m, [*want, 12345, -10**12])
    assert {k: sorted(x.tolist() for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    big = max(m, key=lambda x: x["n_docs"])
    shard, sizes = token_store.Shard(f"{big['name']}.ids", f"{big['name']}.idx"), []
    shard._read = lambda name, at, size, read=shard._read: sizes.append(size) or read(name, at, size)
    shard.find(big["most"])
    assert sum(sizes) < 72 * 12 + 20
    with pytest.raises(ValueError):
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), end_id=70_000, width=2)
    wide = token_store.write(spark.createDataFrame(rows[:3], "doc_id long, text string"), end_id=70_000)
    assert token_store.fetch(wide, [-500])[-500][0].tolist()[-1] == 70_000


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(np.unique(keys))))


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, window):
    d = docs(spark)
    rows = packing.pack(d, window=window).collect()
    t = tokens.encoder("word", tokens.public("word_bpe_49k.json")).tokenizer
    seq, by = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0
    for x in d.collect():
        ids, at = np.array([*t.encode(x.text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[x.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_odd_rows(spark):
    assert packing.pack(spark.createDataFrame(ODD, DOC)).count() == 5
    assert packing.pack(docs(spark).limit(0)).count() == 0
    assert packing.closest({3: 2, 5: 1}, 9) in ({3: 1, 5: 1},)


def brute_hits(items, text, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = find(text)
    hit, found = [0] * len(w), set()
    for i, t in items:
        q = find(t)
        k = min(window, len(q))
        for s in range(len(q) - k + 1 if q else 0):
            for a in range(len(w) - k + 1):
                if w[a : a + k] == q[s : s + k]:
                    found.add(i)
                    hit[a : a + k] = [1] * k
    return len(w), sum(hit), found


def test_automaton_equals_brute_force():
    r = random.Random(3)
    for _ in range(600):
        window, letters = r.choice([1, 2, 3, 4]), r.choice(["ab", "abc", "aB\u00e91"])
        make = lambda n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 2))) for _ in range(n))  # noqa: B023, E731
        items = [(i, make(r.randint(0, 9))) for i in range(r.randint(0, 5))]
        text = make(r.randint(0, 30)) + r.choice(["", ", "]) + (items[0][1] if items else "")
        for block in (4, 1000):
            hit, found = decontam._scan(decontam.automata(items, window, block), decontam.words_of(text))
            assert (len(hit), int(hit.sum()), found) == brute_hits(items, text, window)


def test_report_equals_brute_force(spark):
    d, b = docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in b.collect()] + [(900, "one two"), (901, None), (902, ""), (903, "ONE two")]
    rows = [(r.doc_id, r.text) for r in d.limit(60).collect()] + [(5000, items[0][1] + " zz"), (5001, "so One, two."), (5002, None), (5002, ""), (5003, " ".join(["x"] * 60_000) + " one two")]
    rows += [(6000 + i, t) for i, (_, t) in enumerate(items[:25])]
    bench, table_ = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        q = find(t)
        k = min(10, len(q))
        for s_ in range(len(q) - k + 1 if q else 0):
            windows[tuple(q[s_ : s_ + k])].add(i)
    want = []
    for k, t in rows:
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= own
        want.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    for block in (40, 2_000_000):
        assert sorted(map(tuple, decontam.report(table_, bench, block_words=block).collect())) == sorted(want)
    assert decontam.report(table_.limit(0), bench).count() == 0 and decontam.report(table_, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_cuts_and_keeps(spark):
    d, b = docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    before, after = decontam.report(d, b).where("contaminated").count(), decontam.decontaminate(d, b)
    assert before > 0 and decontam.report(after, b).where("contaminated").count() == 0 and after.columns == d.columns
    assert decontam.report(spark.createDataFrame(ODD, DOC), b).where("n_hit = 0").count() == 5


def brute_classes(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    p = list(range(len(rows)))

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            p[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def test_set_join_equals_brute_force(spark):
    r, rows = random.Random(5), []
    for _ in range(5):
        base = [r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.choice([6, 20, 40]))]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"q{r.randrange(50)}"
            rows.append((len(rows) * 7 % 1000, "  ".join(w) + "\n"))
    rows += [(None, None), (5, ""), (6, " \n"), (None, rows[0][1]), (7, rows[0][1]), (7, "one two"), (8, "One Two"), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in setjoin.near_duplicates(df, size=2, num=7, den=10, heavy=4).collect()), key=str)
    assert got == brute_classes(rows, 2, 7, 10)
    assert setjoin.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("heavy,most", [(4, 4_000_000), (2, 2)])
def test_set_join_of_hot_groups(spark, heavy, most):
    r, rows = random.Random(11), []
    base = [f"w{i}" for i in range(60)]
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"q{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(150)] + [(400 + i, " ".join(["the of and"] * 5 + [f"z{i} y{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in setjoin.near_duplicates(df, size=3, num=4, den=5, heavy=heavy, most_heavy=most).collect()), key=str)
    assert got == brute_classes(rows, 3, 4, 5)


def test_pairs_of_index_lists_equal_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(60):
        rows = []
        for sh in range(r.integers(1, 4)):
            m, roots = int(r.integers(1, 200)), int(r.integers(1, 6))
            rows += [(sh, int(n), int(p), int(k), int(k) % roots) for n, p, k in zip(r.integers(5, 60, m), r.integers(0, 5, m), r.choice(10**6, m, replace=False))]
        rows.sort()
        c = {k: np.array([x[i] for x in rows]) for i, k in enumerate(("shingle", "n", "pos", "node", "root"))}
        want = []
        for x, y in combinations(rows, 2):
            need = -(-85 * (x[1] + y[1]) // 185)
            if x[0] == y[0] and x[4] != y[4] and min(x[1], y[1]) * 100 >= max(x[1], y[1]) * 85 and min(x[1] - x[2], y[1] - y[2]) >= need:
                want.append((min(x[3], y[3]), max(x[3], y[3])))
        assert sorted((int(a), int(b)) for part in setjoin._pairs(c, 85, 100) for a, b in zip(part[0], part[1])) == sorted(want)


def test_one_of_each_tells_rows_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (None, a), (None, "unlike"), (None, None), (4, "c d e"), (4, "c d e"), (5, ""), (5, ""), (6, None)]
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, `_gone_key` int, `_key` string")
    left = setjoin.one_of_each(df)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (None, "unlike"), (None, None), (4, "c d e"), (5, ""), (5, ""), (6, None)], key=str)
    assert setjoin.one_of_each(df.limit(0)).count() == 0


def test_word_hashes_tell_words_apart():
    from streamgauge.llm.wordhash import word_hashes

    of = lambda *w: word_hashes(np.frombuffer(b" ".join(w), np.uint8)).tolist()
    for k in (1024, 4096):
        a = bytes(97 + bin(i).count("1") % 2 for i in range(k))
        assert len(set(of(a, bytes(195 - x for x in a)))) == 2
    assert of(b"Ab", b"x" * 100, b"Y" * 64, b"ab", b"X" * 100) == [*of(b"ab"), *of(b"x" * 100), *of(b"y" * 64), *of(b"aB"), *of(b"x" * 100)]
    words = {b"%x" % (i * i) for i in range(50_000)}
    assert len(set(of(*words))) == len(words)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_counts(t):
    t = t or ""
    w, at = WORD.findall(t), defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a", "b", "\u00e9", "\U0001f642", " ", "\n", "  ", "#", "\t"]) for _ in range(r.randint(0, 300)))) for i in range(150)] + [(None, None), (1, ""), (2, "x y z " * 200)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for q in got:
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_counts(q.text)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words) and not (q.base_failed and q.kept)


def test_quality_order_changes_no_verdict(spark):
    d = docs(spark).select("doc_id", "text")
    kept_ = {r.doc_id for r in quality.judged(d).where("kept").select("doc_id").collect()}
    brute = set()
    for r in d.collect():
        n, chars, symbols, same, again = brute_counts(r.text)
        lines = sum(1 for x in r.text.split("\n") if WORD.search(x))
        letters, capitals = len(re.findall("[A-Za-z]", r.text)), len(re.findall("[A-Z]", r.text))
        runs = len(re.findall(r"[^\W\d_]+", r.text))
        bad = n < 50 or 100 * again > 50 * n or chars < 2 * n or chars > 20 * n or 5 * symbols > n or lines >= 6 and 2 * same > lines or 2 * capitals > letters or 5 * len(re.findall("!+", r.text)) > n or 2 * runs < n
        brute |= set() if bad else {r.doc_id}
    assert kept_ == brute
    odd = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "a b " * 40, 9)], "doc_id long, text string, n_words long")
    assert {r.doc_id for r in quality.passing(d).collect()} == brute and quality.passing(odd, least_words=1).count() == 0 and quality.passing(d.limit(0)).count() == 0
    assert quality.passing(odd.where("doc_id = 1"), rules=(quality.RULES[0],), least_words=0).collect() == [(1, None, 7)]
    order = [r.name for r, _, _ in quality.ordered(d, (*quality.base(), *quality.RULES))]
    assert sorted(order) == sorted(r.name for r in (*quality.base(), *quality.RULES)) and order.index("few_words") < order.index("repeats")


def test_quality_keeps_good_documents(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs(spark), "doc_id").where(F.size(F.split("text", r"\s+")) >= 60)
    assert quality.passing(good.select("doc_id", "text")).count() == good.count()


def test_cascade_is_exact(spark):
    pages = spark.range(3000).select(F.concat(F.lit("http://w.H"), "id", F.lit(".x/p?q")).alias("url"), F.lit("old").alias("host"), F.lit(1).alias("odd"))
    listed = spark.createDataFrame([(f"h{i}.x",) for i in range(0, 3000, 7)] + [("H1.x",), (None,), ("h2",), ("x.h3.x",)], "key string")
    for most in (16_000_000, 400):
        out = url_filter.judge(pages, listed, [], most_bytes=most)
        assert out.columns == ["url", "odd", "host", "path", "rule", "verdict"] and out.count() == 3000
        assert out.where("(verdict = 'block') <> (cast(regexp_extract(host, '[0-9]+', 0) as int) % 7 = 0)").count() == 0
    odd = url_filter.judge(spark.createDataFrame([(None,), ("no host",), ("a://B.c:80/x#y",), ("a://" + "q." * 3000 + "h7.x/" + "z" * 9000,), ("a://h7.x",), ("a://h7.x",)], "url string"), listed, [("c:80/x", "block")])
    assert sorted(r.verdict for r in odd.where("rule is null").collect()) == ["allow"] * 2 + ["block"] * 3
    assert odd.where("rule is not null").first().host == "b.c:80"
    assert url_filter.judge(pages.limit(0), listed, []).count() == 0 and url_filter.judge(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_cascade_levels_decide(spark):
    hosts = spark.createDataFrame([(f"k{i}",) for i in range(400)], "key string")
    c = url_filter.Cascade(hosts, hosts.where("key like '%3'"))
    assert len(c.levels) > 1 and hosts.where(c.contains(F.col("key")) != F.col("key").like("%3")).count() == 0
    c.levels = c.levels[:1]
    assert hosts.where(c.contains(F.col("key")) & ~F.col("key").like("%3")).count() > 0


def test_blocked_domains_block_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert url_filter.judge(pages, url_filter.blocked_domains(spark), []).where("verdict = 'block'").count() > 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for i, k in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[k], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0
            if not (k == "ip" and any(int(p) > 255 for p in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and luhn) or k == "phone" and not 10 <= len(d) <= 15):
                out.append((m.start(), i, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base_and_context(spark):
    q = random.Random(4)
    bits = ["a", "0", "1", "22", "00", "300", "10.0.0.1", "@", ".", "+", "-", " ", "(", ")", "\u00e9", "\U0001f642", "4111111111111111", "b@c.de", "_"]
    rows = [(i, "".join(q.choice(bits) for _ in range(q.randint(0, 60)))) for i in range(600)] + [(-1, ""), (-2, None), (-3, "a1@b.c " * 700)]
    text = dict(rows)
    for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.base_sha256 == hashlib.sha256(brute_spans(text[r.doc_id]).encode()).hexdigest() and (r.n_added or r.spans == brute_spans(text[r.doc_id]))
    cue = [(i, f"please write my address to u{i}@mail{i}.example.com today, thanks") for i in range(9)] + [(20, "please write my address to bob (at) home today, thanks"), (21, "so bob (at) home is here")]
    assert [(r.doc_id, r.spans) for r in pii.spans(spark.createDataFrame(cue, "doc_id long, text string")).where("n_added > 0").collect()] == [(20, "email:27:40")]


def test_pii_base_of_zero_parts(spark):
    rows = [(i, t) for i, t in enumerate(["at 10.0.0.1 now", "127.0.0.1", "0.1.2.3", "000.00.0.0256", "8.8.8.8", "1.2.3.256"])]
    assert [r.n_ip for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 1, 1, 0, 1, 0]


def test_pii_patterns_find_what_base_patterns_miss(spark):
    luhn = lambda d: sum(v - 9 if v > 9 else v for v in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0
    good = [n for n in map(str, range(4111111111111111, 4111111111111400)) if luhn(n)][:8]
    rows = [(i, f"w{i} seen {n} x{i}") for i, n in enumerate(good)] + [(20, "one 9807915762804490 two"), (21, "order#9807915762804491 two"), (22, "1234567890123456789012 six")]
    rows += [(30 + i, f'set token = "{hashlib.sha1(bytes([i])).hexdigest()}" here') for i in range(6)] + [(40, 'a token = "letmein-2024-please" b'), (41, f"git {hashlib.sha1(b'x').hexdigest()} fixed")]
    rows += [(50 + i, f'v{i} token = "123456789012345678901{i}" b') for i in range(1)]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "card:4:20" and got[21] == "" and got[22] == "" and got[41] == "" and got[50] == ""
    assert got[30] == "secret:13:53" and got[40] == "secret:11:30"
    off = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), least_seeds=100).collect()}
    assert off[20] == off[30] == off[40] == "" and off[0] == got[0]


def test_pii_of_planted_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shapes = r"[0-9]{16}|token = |@mail|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\+1 \("
    found = pii.spans(d).join(d.select("doc_id", F.col("text").rlike(shapes).alias("planted")), "doc_id")
    r = found.agg(F.count_if("planted").alias("p"), F.count_if(F.col("planted") & (F.col("n_spans") > 0)).alias("hit"), F.count_if(~F.col("planted") & (F.col("n_spans") > 0)).alias("wrong")).first()
    assert r.hit >= 0.95 * r.p and r.wrong <= 0.01 * (found.count() - r.p)


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/", "small"), (4, "http://d/", "small"), (None, "http://e/", big), (5, "http://f/", None), (2, None, big), (7, "http://g/", "y" * 1000)]
    out = warc.assemble(warc.read(spark, warc.write(spark.createDataFrame(rows, "page_id long, url string, html string")))).collect()
    assert len(out) == len(rows) and all(r.request.record_type == "request" and r.metadata.record_type == "metadata" for r in out)
    key_of = {r.response.record_id: r.response.capture_key for r in out if r.response.record_type == "response"}
    kinds = sorted((str(r.response.capture_key), r.response.record_type, r.response.refers_to and key_of[r.response.refers_to]) for r in out)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("7", "response", None), ("None", "response", None)])
    for r in out:
        if r.response.record_type == "response":
            assert hashlib.sha1(r.response.content).hexdigest() == r.response.payload_digest
    assert warc.assemble(warc.read(spark, [])).count() == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert line_dedup.patience([5, 1, 2, 6], [7, 1, 2, 8]) == [(1, 1), (2, 2)]


def plain_patience(a, b, words):
    """Patience alignment written again, by recursion: equal ends, unique common lines in their longest rising order, else the heaviest common run."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:], words[1:])]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], words[:-1]), (len(a) - 1, len(b) - 1)]
    both = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = [[(p, q)] for p, q in both]
    for i, (_, q) in enumerate(both):
        longer = [best[k] for k in reversed(range(i)) if both[k][1] < q]  # of equally long ones the last
        if longer:
            best[i] = max(longer, key=len) + best[i]
    chain = max(reversed(best), key=len, default=[])
    if not chain:
        runs = [(sum(words[j : j + n]), -j - n, i, j, n) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]]
        if not runs:
            return []
        _, _, i, j, n = max(runs, key=lambda r: (r[0], r[1], -r[2]))
        chain = [(i + k, j + k) for k in range(n)]
    out, i, j = [], 0, 0
    for p, q in [*chain, (len(a), len(b))]:
        out += [(x + i, y + j) for x, y in plain_patience(a[i:p], b[j:q], words[j:q])] + ([(p, q)] if p < len(a) else [])
        i, j = p + 1, q + 1
    return out


def plain_gone(a, b, words, least):
    """Places of ``b`` in aligned runs, without a gap on either side, of enough words."""
    pairs, gone = sorted(plain_patience(a, b, words)), set()
    at = 0
    while at < len(pairs):
        end = at + 1
        while end < len(pairs) and pairs[end] == (pairs[end - 1][0] + 1, pairs[end - 1][1] + 1):
            end += 1
        if sum(words[j] for _, j in pairs[at:end]) >= least:
            gone |= {j for _, j in pairs[at:end]}
        at = end
    return gone


def plain_line_dedup(rows, least=20):
    """rows: (key, text) of distinct keys. Text and number of lines cut, by aligning all pairs."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    lines = {k: [strip(x) for x in (t or "").split("\n") if strip(x)] for k, t in rows}
    heads, out = {}, {}
    for k, t in sorted(rows):
        own, words = lines[k], [len(WORD.findall(x)) for x in lines[k]]
        gone = set()
        if sum(words) >= least:
            if tuple(own) in heads:
                gone = set(range(len(own)))
            else:
                for other in heads:
                    if set(other) & set(own):
                        gone |= plain_gone(list(other), own, words, least)
                heads[tuple(own)] = k
        left, i = [], -1
        for x in (t or "").split("\n"):
            wordy = bool(strip(x))
            i += wordy
            if not (i in gone and (wordy or i + 1 in gone)):
                left.append(x)
        out[k] = ("\n".join(left) if gone else t, len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    d = docs(spark)
    want = plain_line_dedup([(r.doc_id, r.text) for r in d.collect()])
    assert sum(n for _, n in want.values()) > 0
    for r in line_dedup.without_common_lines(d, rare=3).collect():
        assert (r.text, r._gone) == want[r.doc_id] and r.n_chars == (len(r.text) if r._gone else r.n_chars)


def test_line_dedup_of_random_lines_equals_brute_force(spark):
    r = random.Random(12)
    pool = [" ".join(f"p{i}w{j}" for j in range(r.randint(3, 12))) for i in range(9)]
    rows = [(i, "\n".join(r.choice([*pool, "", " ", f"own {i}"]) for _ in range(r.randint(0, 9)))) for i in range(120)] + [(500, None), (501, "")]
    want = plain_line_dedup(rows)
    for rare in (2, 16):
        got = {x.doc_id: (x.text, x._gone) for x in line_dedup.without_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()}
        assert got == want


def test_passages_repeated_in_a_document_are_aligned():
    p, lines = ["p1", "p2", "p3"], lambda b: [20 if x in "p1p2p3" else 1 for x in b]
    for a, b, gone in [(["x", *p, "y"], ["u", *p, "w", *p, "v"], [1, 2, 3]), (["x", *p, "w", *p, "y"], ["u", *p, "v"], [1, 2, 3]), (["x", *p, "w", *p, "y"], ["u", *p, "z", *p, "v"], [1, 2, 3, 5, 6, 7])]:
        assert line_dedup.common_blocks(a, b, lines(b), 20) == gone
    r = random.Random(6)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 14))] for _ in range(2))
        w = [r.randint(1, 9) for _ in b]
        i, j, n = line_dedup._heaviest(a, b, w)
        assert a[i : i + n] == b[j : j + n]
        assert sum(w[j : j + n]) == max((sum(w[y : y + k]) for k in range(15) for x in range(len(a) - k + 1) for y in range(len(b) - k + 1) if a[x : x + k] == b[y : y + k]), default=0)
        found = line_dedup.patience(a, b, w)
        assert all(a[x] == b[y] for x, y in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert bool(found) == bool(set(a) & set(b))


@pytest.mark.parametrize("rare", [2, 16])
def test_line_dedup_of_frequent_lines_equals_all_pairs(spark, rare):
    frequent = [" ".join(f"f{i}w{j}" for j in range(15)) for i in range(4)]
    rows = [(100 * i + j, f"own {i} {j}\n{x}\nend {i} {j}") for i, x in enumerate(frequent) for j in range(20)]
    rows += [(500, "\n".join(["a b", *frequent, "c"])), (900, "\n".join(["d", *frequent, "e f"]))]
    r = random.Random(8)
    pool = [" ".join(f"p{i}w{j}" for j in range(r.randint(3, 12))) for i in range(7)]
    rows += [(1000 + i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(90)]
    rows += [(2000 + i, rows[-1 - i % 7][1]) for i in range(15)]
    got = {x.doc_id: x._gone for x in line_dedup.without_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare, length_column=None).collect() if x._gone}
    assert got[900] == 4 and got == {k: n for k, (_, n) in plain_line_dedup(rows).items() if n}


def test_line_dedup_odd_rows(spark):
    assert line_dedup.without_common_lines(spark.createDataFrame(ODD, DOC)).count() == 5
    p, own = " ".join(f"p{i}" for i in range(25)), "a word or two"
    rows = [(1, p), (2, f"{own}\n{p}"), (2, f"x\n{p}"), (2, f"x\n{p}"), (None, p), (3, p), (4, own), (5, None)]
    df = spark.createDataFrame([(*r, i, "v") for i, r in enumerate(rows)], "doc_id long, text string, `_gone` int, `_k` string")
    out = line_dedup.without_common_lines(df, length_column=None)
    assert out.columns == ["doc_id", "text", "_k", "_gone"]
    assert sorted(((r.doc_id, r.text, r._gone) for r in out.collect()), key=str) == sorted([(1, p, 0), (2, own, 1), (2, "x", 1), (2, "x", 1), (None, p, 0), (3, "", 1), (4, own, 0), (5, None, 0)], key=str)
    assert sorted(r.doc_id or 0 for r in line_dedup.without_common_lines(df, length_column=None, least_left=0.1).collect()) == [0, 1, 2, 4, 5]
    assert line_dedup.without_common_lines(df.limit(0)).count() == 0


def test_license(spark):
    mit = "Copyright (c) 2020 X\n\n" + license_scan.KNOWN["MIT"].replace(", ", ",\n").upper()
    rows = [(1, mit), (2, None), (3, "..."), (4, "licensed under the apache LICENCE version 2.0")]
    assert {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: "MIT", 2: None, 3: None, 4: "Apache-2.0-short"}


def test_license_of_whole_files(spark):
    mit = "Copyright (c) 2020 X\n\n" + license_scan.KNOWN["MIT"]
    bsd = (Path(license_scan.__file__).parent / "licenses" / "BSD-3-Clause.txt").read_text()
    common = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [("MIT License\n\n" + mit, "MIT"), ("The MIT License (MIT)\n" + mit, "MIT"), (f"BSD 3-Clause License\n\nCopyright (c) 2001, Y\nAll rights reserved.\n\n{bsd}", "BSD-3-Clause"), (bsd.replace("\n", " "), "BSD-3-Clause"), ("some words and " + bsd, None)]
    texts += [("Copyright 2020 Jane Doe\n" + license_scan.KNOWN["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS"), "MIT"), ("// (C) X\n" + license_scan.KNOWN["ISC"].replace("the above copyright notice", "the above\ncopyright notice"), "ISC")]
    texts += [(Path("/usr/share/common-licenses", f).read_text(), name) for f, name in common.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: name for i, (_, name) in enumerate(texts)}
    import duckdb

    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()  # noqa: F841
    want = {i: (d, n) for i, d, n in duckdb.sql(license_scan.sql()).fetchall()}
    again = license_scan.scan(spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, license string"))
    assert {r.doc_id: (r.license_sha256, r.license) for r in again.collect()} == want and again.columns == ["doc_id", "text", "license_sha256", "license"]
    kinds = {n for n, _ in license_scan.known_texts()}
    assert {"BSD-2-Clause", "Unlicense", "LGPL-2.0", "MPL-1.1", "GFDL-1.3"} <= kinds


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d, kept = docs(spark), None
    for name, stage in corpus_pipeline.STAGES:
        kept = d
        d = stage(spark, d, SF)
        if name != "packing":
            assert d.columns == kept.columns
    assert set(r.doc_id for r in d.select("doc_id").distinct().collect()) == set(r.doc_id for r in kept.select("doc_id").collect())


def plain_quality(t):
    n, chars, symbols, same, again = brute_counts(t)
    lines = sum(1 for x in t.split("\n") if WORD.search(x))
    letters, capitals = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
    bad = n < 1 or 100 * again > 50 * n or chars < 2 * n or chars > 20 * n or 5 * symbols > n or lines >= 6 and 2 * same > lines or 2 * capitals > letters
    return not (bad or 5 * len(re.findall("!+", t)) > n or 2 * len(re.findall(r"[^\W\d_]+", t)) < n)


def plain_decontaminated(items, t, window=10):
    """The text without runs of words in benchmark windows; None where half of its words are."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
    words, hit = [lower(t[a:b]) for a, b in spans], set()
    for _, x in items:
        q = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
        k = min(window, len(q))
        own = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else set()
        for i in range(len(words) - k + 1 if own else 0):
            if tuple(words[i : i + k]) in own:
                hit |= set(range(i, i + k))
    if not hit:
        return t
    if len(hit) >= 0.5 * len(words):
        return None
    out, done = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += t[done : spans[i][0]].rstrip(" \t")
        done = spans[i][1]
    return out + t[done:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    items = [(i, say(30)) for i in range(3)] + [(3, "short item")]
    passage = [say(15) for _ in range(4)]
    rows = [(i, "\n".join(say(12) for _ in range(r.randint(1, 8)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(110 + i, rows[i + 5][1].replace(" ", "  ", 3)) for i in range(3)]
    rows += [(120 + i, "\n".join([say(30), *passage, say(30)])) for i in range(3)] + [(130 + i, f"{say(40)} {items[i][1]} {say(40)}") for i in range(3)]
    long = say(150).split(" ")
    rows += [(140, " ".join(long)), (141, " ".join([*long[:70], "other", *long[71:]])), (150, items[0][1]), (151, "## ** || $$ %%"), (152, "WE SHOUT HERE AND NOW"), (153, "a " * 90), (154, ""), (155, None)]
    (tmp_path / "sf").mkdir()
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(5).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    good = [(k, t) for k, t in rows if plain_quality(t or "")]
    cut = plain_line_dedup(good)
    lined = [(k, cut[k][0]) for k, t in good if not cut[k][1] or len(WORD.findall(cut[k][0])) >= 0.2 * len(WORD.findall(t))]
    classes = {k: c for k, _, c in brute_classes(lined, 5, 4, 5)}
    clean = {k: x for k, t in lined if classes[k] == k and (x := plain_decontaminated(items, t)) is not None}
    assert len(good) < len(rows) and len(lined) < len(good) and len(classes) > len(set(classes.values())) and 150 not in clean and any(clean[k] != t for k, t in lined if k in clean)
    got, sequences = defaultdict(list), defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect():
        got[x.doc_id].append(x)
        sequences[x.sequence_id].append((x.offset, x.length))
    assert set(got) == set(clean)
    t = Tokenizer.from_file(tokens.public("word_bpe_49k.json"))
    for k, pieces in got.items():
        ids, at = np.array([*t.encode(clean[k], add_special_tokens=False).ids, 2], "<u4"), 0
        for x in sorted(pieces, key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    for s_ in sequences.values():
        at = 0
        for o, n in sorted(s_):
            assert o == at
            at += n
        assert at <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "one two three " * 20, "http://a.example.com/x", "<p>" + "y" * 1200, 5)] * 2 + [(None, None, None, None, None)]
    names = ["n_words", "kept", "host", "verdict", "license", "start", "spans", "key", "same", "text_id", "part", "rest", "n_hit", "_own", "_t", "component_id", "digest"]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, html string, n_chars int").withColumns({n: F.lit(1) for n in names})
    assert quality.judged(df).select("kept").count() == 3 and quality.passing(df).columns == df.columns and pii.spans(df).count() == 3 and license_scan.scan(df).select("license").count() == 3
    assert url_filter.judge(df, spark.createDataFrame([("example.com",)], "key string"), []).where("verdict = 'block'").count() == 2


def test_clashing_names_of_stored_operators(spark):
    rows = [(1, "one two three " * 20, "u", "y" * 1200, 5)] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, html string, `key` int").withColumns({n: F.lit(1) for n in ("start", "holder", "digest", "n", "rest", "part", "same", "h", "node", "component_id", "chosen")})
    assert token_store.read_back(spark, token_store.write(df)).count() == 3 and packing.pack(df).select("doc_id").distinct().count() == 2
    assert warc.assemble(warc.read(spark, warc.write(df.withColumn("page_id", F.col("doc_id"))))).count() == 3
    assert setjoin.near_duplicates(df).count() == 3 and setjoin.one_of_each(df).count() == 2
    assert line_dedup.without_common_lines(df).count() == 3 and decontam.report(df, df.select(F.lit(1).alias("item_id"), "text")).count() == 3


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, url string, html string, page_id long")
    listed = spark.createDataFrame([], "key string")
    for out in (quality.judged(df), quality.passing(df), pii.spans(df), license_scan.scan(df), url_filter.judge(df, listed, []), packing.pack(df), setjoin.near_duplicates(df), line_dedup.without_common_lines(df), token_store.read_back(spark, token_store.write(df)), warc.assemble(warc.read(spark, warc.write(df)))):
        assert out.count() == 0


def test_very_long_texts(spark):
    rows = [(1, "".join(chr(97 + i % 26) for i in range(300_000))), (2, "ab cd, e.f@g.hi 10.0.0.1\n" * 6000), (3, " " * 200_000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in quality.judged(df).select("doc_id", "n_words").collect()} == {1: 1, 2: 24_000, 3: 1}
    assert {r.doc_id: (r.n_email, r.n_ip) for r in pii.spans(df).collect()} == {1: (0, 0), 2: (6000, 6000), 3: (0, 0)}
    assert license_scan.scan(df).where("license is not null").count() == 0


def test_very_long_texts_of_stored_operators(spark):
    rows = [(1, "".join(chr(97 + i % 26) for i in range(300_000))), (2, "ab cd, e.f@g.hi 10.0.0.1\n" * 6000), (3, " " * 200_000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.without_common_lines(df).count() == 3 and packing.pack(df).agg(F.sum("length")).first()[0] > 100_000
    assert sorted(r.n_shingles for r in setjoin.near_duplicates(df).collect()) == [1, 1, 4]
    assert decontam.report(df, df.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")).where("contaminated").count() == 1
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert [r.response.payload_bytes for r in warc.assemble(warc.read(spark, warc.write(pages))).orderBy("response.capture_key").collect()] == [300_000, 150_000, 200_001]
