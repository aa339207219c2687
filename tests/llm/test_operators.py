"""Corpus operators on small tables: brute force, round trips, and every awkward row."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import components, decontaminate, embeddings, katz, langid, linededup, mixing, secrets, simhash, tokenstore, warc
from tracewright.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size int, line int"
WORDS = "alpha beta gamma delta the of and zeta eta theta iota kappa lambda mu nu xi".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(0, 6000)
    rows = [(1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "b"), (2, prose(1, 80), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "de", "b"), (6, long, "en", "a"), (7, long + " tail", "en", None), (8, "Ünïcode «x» 中文 😀 !!! 123", "de", "c"), (None, "nobody here", None, "a"), (None, None, None, None), (9, "12345 %%% 678", "en", "c")]
    return spark.createDataFrame([(*r, None, "clash", 7, 8) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long").where("a is not null")).collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


# -- 1


def test_warc(spark):
    same = "x" * 150
    rows = [(5, "http://a.b.com/p?q=1", same), (3, "http://b.com/", same), (3, "http://b.com/", same), (4, None, None), (6, "not a url \r\n", "short"), (7, "http://[bad", "short"), (None, "http://a.b.com:8080/é", same), (8, "http://b.com/", "é" * 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(pages).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == same and i != 3
        want.append((i or -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want)
    assert warc.digest(pages.limit(0)).count() == 0
    assert warc.surt("HTTP://A.b.COM:80/x#f") == "com,b,a)/x"


def test_warc_index_bisects(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.com/p{i % 40}", f"page {i}") for i in range(200)], "page_id long, url string, html string")
    folder, top = warc.write(pages.repartition(3), shard_rows=60)
    index = warc.Index(folder, [tuple(r) for r in top.select("key", "last", "stem").collect()])
    assert len(index.shards) > 1
    for i in range(0, 200, 13):
        hits = sorted(c[0] for c in index.lookup(warc.surt(f"http://h{i % 9}.com/p{i % 40}")))
        assert hits == [j for j in range(200) if j % 9 == i % 9 and j % 40 == i % 40]
    assert index.lookup("com,nosuch)/") == []


def test_warc_with_a_hot_url_and_a_long_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    rows = [(i, "http://hot.com/", f"page {i}") for i in range(150)] + [(i, None, f"bare {i}") for i in range(150, 200)] + [(200, "http://a.com/", "long " * 700_000), (201, "http://b.com/", "long " * 700_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, top = warc.write(pages, shard_rows=40)
    shards = top.collect()
    assert sum(r.key <= "com,hot)/" <= r.last for r in shards) > 2
    got = warc.lookup(spark.createDataFrame([("com,hot)/",), ("-",), ("no,such)/",)], "key string"), folder, top)
    assert sorted(r.page_id for r in got.collect()) == list(range(200))
    told = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.digest(pages).collect()}
    assert len(told) == 202 and told[200] == (3_500_000, "response", None) and told[201] == (3_500_000, "revisit", 200)


# -- 2


def test_mixing(spark, docs, empty):
    many = spark.createDataFrame([(i, prose(i, 1 + i % 37), f"s{min(i % 11, 6)}") for i in range(1500)], "doc_id long, text string, source string")
    got = mixing.digest(many).toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), said=("source_size", "first"))
    assert (by["size"] == by["said"]).all() and (got["taken"] <= 3 * got["size"]).all()
    w, cap = {s: i % 3 + 1 for i, s in enumerate(sorted(by.index))}, 3 * by["size"]
    level, total, open_ = {}, by["size"].sum(), set(by.index)
    while True:  # fill up by weight, fixing what overflows
        share = {s: (total - sum(level.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            level |= share
            break
        level |= {s: cap[s] for s in over}
        open_ -= over
    assert all(abs(by["target"][s] - level[s]) < 1e-6 * total for s in by.index)
    assert (abs(by["taken"] - by["target"]) <= 37).all()
    again = mixing.digest(many.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    odd = mixing.digest(docs).toPandas()
    assert len(odd) == 12 and odd["taken"].sum() == pytest.approx(odd["size"].sum(), rel=0.7)
    assert mixing.digest(empty).count() == 0
    rep = mixing.repeated(docs)
    assert rep.columns == docs.columns and rep.count() == int(odd["copies"].sum())


def test_mixing_solves_the_tilt(spark):
    """Multipliers and copies against bisection of each source's own equation."""
    rows = [(i, prose(i, 1 + i * 7 % 53), f"s{i % 7 // 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    sized = mixing.sizes(docs).groupBy("source", "size").agg(F.count("*").alias("docs"))
    aims = mixing.targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n")))
    lam = {r.source: (r.lam, r.full) for r in mixing.solve(sized, aims).collect()}
    for source, part in got.groupby("source"):
        size, target = part["size"].to_numpy(float), part["target"].iloc[0]
        rate = lambda x: np.minimum(mixing.CAP, np.exp(np.minimum(x * size / size.mean(), 50)))  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if (rate(mid) * size).sum() > target else (mid, high)
        if not lam[source][1]:
            assert lam[source][0] == pytest.approx(low, abs=1e-6)
            assert (abs(part["copies"] - rate(low)) <= 2).all() and abs((part["copies"] * size).sum() - target) <= size.max()
        else:
            assert (part["copies"] == mixing.CAP).all()


# -- 3


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"own line {i}\nshared\n rare \n\nlast {i % 3}", f"s{i % 7}" if i % 2 else None) for i in range(40)]
    got = {r.doc_id: r for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sites = {}
    for _, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(x.strip(" "), set()).add(s)
    for i, t, _ in rows:
        keep = [x for x in t.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < linededup.MIN_SITES]
        assert got[i].text == "\n".join(keep) and got[i].n_removed == 5 - len(keep)
    assert linededup.clean(docs).columns == [*docs.columns, "n_removed"] and linededup.clean(docs).count() == 12
    assert linededup.digest(empty).count() == 0


# -- 4


def test_language_id(spark, docs, empty):
    def text(lang, i):
        r = random.Random(f"{lang}{i}")
        syllables = {"aa": "ka lo mi tu re", "bb": "sch ung ein ver tz"}[lang].split()
        return " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(40))

    rows = [(i, text(lang, i), lang) for i in range(300) for lang in ("aa", "bb")]
    table = spark.createDataFrame([(2 * i + (x == "bb"), t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    got = langid.digest(table).join(table, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    model = langid.fit(table)
    lang, score, out = model.predict(["", None, "123 !!", "中文字符测试" * 20, text("aa", 999)])
    assert lang[:3] == ["und"] * 3 and out == [True, True, True, True, False] and lang[4] == "aa" and 0 <= score[4] <= 1
    odd = {r.doc_id: r for r in langid.digest(docs).collect()}
    assert odd[9].lang_pred == "und" and odd[4].lang_pred == "und" and len(langid.digest(docs).collect()) == 12
    assert langid.digest(empty).count() == 0
    bare = langid.predict(docs, langid.fit(docs.where("false"))).collect()
    assert all(r.language.lang == "und" for r in bare) and not next(r for r in bare if r.doc_id == 1).language.rejected


def test_language_rejection(spark):
    """Of these texts, in no trained language, all are rejected, and below 1 % of the trained ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
        "xq zzk vvr qwx kjh bnm plk",
    ]
    assert all(model.predict([" ".join([t] * n) for t in foreign for n in (1, 3, 20)])[2])
    own = langid.predict(docs, model).where("text is not null").select("language.rejected").toPandas()["rejected"]
    assert own.mean() < 0.01


def test_language_floors_by_length():
    scale = np.repeat([2, 5, 6, 9], [3, 60, 10, 50])
    got = langid.floors(scale, np.repeat([0.1, 0.4, 0.6, 0.8], [3, 60, 10, 50]))
    assert (got[:6] == got[0]).all() and got[0] == pytest.approx(langid.SLACK * np.quantile([0.1] * 3 + [0.4] * 60, langid.FLOOR))
    assert (got[6:] == got[6]).all() and 0.3 <= got[6] / langid.SLACK <= 0.8


def test_ties_and_names_already_taken(spark, docs):
    same = spark.createDataFrame([(i, "ka lo mi tu " * 9, x) for i in range(200) for x in ("zz", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.digest(same).collect()} == {"aa"}
    for run, name in ((lambda d: langid.predict(d, langid.fit(docs)), "language"), (linededup.clean, "n_removed")):
        with pytest.raises(ValueError):
            run(docs.withColumn(name, F.lit(1)))


def test_grams_do_not_depend_on_pieces(monkeypatch):
    t = prose(3, 400) + " é!! 中 " + prose(4, 10)
    want = langid.grams(t)
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert (langid.grams(t) == want).all()


# -- 5


class Katz:
    """Brute force: the same model from dictionaries."""

    def __init__(self, rows, held, order):
        from collections import Counter

        self.one, self.two, self.three, k = Counter(), Counter(), Counter(), katz.K
        for i, t in rows:
            w = [*katz.words(t), b""]
            if not held(i):
                self.one.update(w)
                self.two.update(zip([b" ", *w], w))
                self.three.update(zip([b" ", *w], w, w[1:]))
        self.n, self.v, self.order = sum(self.one.values()), len(self.one), order
        self.d2 = katz.discounts([Counter(self.two.values())[r] for r in range(k + 2)])
        self.d3 = katz.discounts([Counter(self.three.values())[r] for r in range(k + 2)], least=2)

    def p1(self, w):
        return (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def back(self, seen, size, d, w, lower):
        if not size:
            return lower(w)
        kept = sum(x * d[min(x, katz.K + 1)] for x in seen.values())
        if not kept:
            return lower(w)
        size = size + 0.5 if kept >= size * (1 - 1e-12) else size
        return seen[w] * d[min(seen[w], katz.K + 1)] / size if w in seen else (size - kept) / size / (1 - sum(map(lower, seen))) * lower(w)

    def p2(self, u, w):
        seen = {y: x for (a, y), x in self.two.items() if a == u}
        return self.back(seen, sum(seen.values()), self.d2, w, self.p1)

    def p(self, t, u, w):
        if self.order == 2 or t is None:
            return self.p2(u, w)
        every = {y: x for (a, b, y), x in self.three.items() if (a, b) == (t, u)}
        return self.back({y: x for y, x in every.items() if x > 1}, sum(every.values()), self.d3, w, lambda y: self.p2(u, y))

    def score(self, text):
        w = [b" ", *katz.words(text), b""]
        return sum(np.log10(self.p(t, u, y)) for t, u, y in zip([None, *w], w, w[1:]))

    def base(self, text):
        return sum(np.log10(self.p1(y)) for y in [*katz.words(text), b""])


@pytest.mark.parametrize("order", [2, 3])
def test_katz(spark, docs, empty, monkeypatch, order):
    monkeypatch.setattr(katz, "SPOOL_BYTES", 2500)
    rows = [(i, " ".join(random.Random(i).choices("a b c d E é f g".split(), [9, 7, 5, 2, 2, 1, 1, 1], k=i % 9))) for i in range(160)] + [(500, None), (None, "a b"), (7, "A b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores, tables = katz.score(table, F.col("doc_id") % 10 == 0, order=order)
    scores, tables = scores.toPandas(), tables.collect()
    held = lambda i: i is not None and i % 10 == 0
    model = Katz(rows, held, order)
    for t, u in [(None, b" "), (None, b"new"), *[x[:2] for x in list(model.three)[:40]], (b"new", b"a")]:
        assert sum(model.p(t, u, w) for w in model.one) + model.p(t, u, b"unseen") == pytest.approx(1, abs=1e-9)
    key = lambda i: -1 if i is None or i != i else int(i)
    want = sorted((key(i), held(i), len(katz.words(t)) + 1, sum(model.one[w] > 0 for w in [*katz.words(t), b""]), model.n, round(model.base(t), 6), round(model.score(t), 6)) for i, t in rows)
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scores.itertuples()) == want
    assert {t.kind for t in tables} == set(range(1, order + (2 if order == 2 else 3)))
    assert katz.score(docs, F.lit(False), order=order)[0].count() == 12 and katz.score(empty, F.lit(False), order=order)[0].count() == 0
    lone = katz.score(table, F.lit(True), order=order)[0].toPandas()
    assert (lone["score"] == 0).all() and (lone["train_tokens"] == 0).all()


def test_katz_counts_beyond_32_bits():
    many = np.array([2**32 - 1], "<u4")
    ask = pa.concat_tables([katz._ask(2, spool, np.array([77], np.uint64), [many], 8) for spool in range(3)])
    said = katz._grams_merged(1)(ask).to_pylist()
    assert katz._said([r for r in said if r["spool"] == 0], 2, ["<u8", "u1"])[0].tolist() == [3 * (2**32 - 1)]
    table = next(r for r in said if r["kind"] == -2)
    assert katz._unpack(table["vals"], "<u8").tolist() == [3 * (2**32 - 1)] and table["stats"][-1] == 3 * (2**32 - 1)
    sums = [np.array([2**40], "<u8"), *[np.array([0], "<u8")] * katz.K, np.array([2], "<u8"), np.array([2**40], "<u8"), np.array([1], "u1")]
    size = katz._contexts_merged(2**41, 9, np.ones(katz.K + 2))(katz._ask(3, 1, np.array([5], np.uint64), sums, 8)).to_pylist()
    assert katz._said(size, 3, ["<f8", "<f8"])[0].tolist() == [2**40 + 0.5]


# -- 6


def test_masks_catch_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(decontaminate.WINDOW), 2):
        assert any(all(c == "0" or o + i not in bad for i, c in enumerate(m)) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - len(m) + 1))


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, prose(50, 30)), (2, prose(51, 20)), (3, "tiny unique item"), (4, None), (5, prose(50, 30)), (6, "")], "item_id long, text string")
    r = random.Random(9)
    rows = []
    for i in range(60):
        item = prose(50 + i % 2, 30 - 10 * (i % 2)).split()
        for j in r.sample(range(len(item)), i // 4):
            item[j] = "changed"
        cut = r.randint(0, 5)
        rows.append((i, f"{prose(100 + i, 40)}, {' '.join(item[cut:]).upper()}! {prose(200 + i, 10)}"))
    rows += [(100, "A TINY, unique item."), (101, prose(400, 300)), (102, "tiny item")]
    got = {x.doc_id: x for x in decontaminate.digest(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    items = {i: decontaminate.tokens(t) for i, t in ((1, prose(50, 30)), (2, prose(51, 20)), (3, "tiny unique item"))}
    for i, t in rows:
        d = decontaminate.tokens(t)
        want = [k for k, item in items.items() if max(decontaminate.agreement(d, item, s) for s in range(-len(item), len(d))) > 0]
        assert got[i].contaminated == bool(want) and got[i].items == (",".join(map(str, want)) if want else None), i
    assert 20 < sum(x.contaminated for x in got.values()) < 62
    assert decontaminate.digest(docs, bench).count() == 12 and decontaminate.clean(docs, bench).columns == docs.columns
    assert not decontaminate.digest(docs, bench.limit(0)).where("contaminated").count() and decontaminate.digest(empty, bench).count() == 0


def test_items_that_share_or_lack_an_id(spark):
    texts = [prose(60 + i, 30) for i in range(6)]
    bench = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (0, texts[2]), (None, texts[3]), (None, texts[4]), (7, texts[4])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(300 + i, 20)} {t} {prose(400 + i, 20)}") for i, t in enumerate(texts)] + [(6, f"{texts[0]} {texts[1]} {texts[3]}")], "doc_id long, text string")
    got = {x.doc_id: (x.contaminated, x.n_items, x["items"]) for x in decontaminate.digest(docs, bench).collect()}
    assert got == {0: (True, 1, "0"), 1: (True, 1, "0"), 2: (True, 1, "0"), 3: (True, 1, ""), 4: (True, 1, "7"), 5: (False, 0, None), 6: (True, 3, "0")}
    assert [x.doc_id for x in decontaminate.clean(docs, bench).collect()] == [5]


def allowed(n):
    from itertools import combinations

    return [bad for k in range(n - -(-4 * n // 5) + 1) for bad in combinations(range(n), k)]


@pytest.mark.parametrize("n", range(1, decontaminate.WINDOW))
def test_short_masks_catch_allowed_substitutions(n):
    for bad in allowed(n):
        assert any(all(c == "0" or i not in bad for i, c in enumerate(m)) for m in decontaminate.short_masks(n))


def test_short_items_with_substitutions(spark):
    bench = spark.createDataFrame([(n, prose(500 + n, n)) for n in range(1, 13)], "item_id long, text string")
    rows, want = [], {}
    for n in range(1, 13):
        item = prose(500 + n, n).split()
        for bad in [*allowed(n), range(-(-n // 3) + 1)]:
            want[len(rows)] = len(bad) <= n - -(-4 * n // 5)
            rows.append((len(rows), " ".join(["zz", *("changed" if i in bad else w for i, w in enumerate(item)), "yy"])))
    got = {x.doc_id: x.contaminated for x in decontaminate.digest(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want


# -- 7


def test_covering_masks_miss_no_pair():
    from itertools import combinations

    masks = simhash.covering(list(range(64)), 4)
    r = random.Random(1)
    spots = [r.sample(range(64), 4) for _ in range(4000)] + list(combinations(range(0, 64, 5), 4))
    assert all(any(not any(m >> p & 1 for p in s) for m in masks) for s in spots)
    assert min(m.bit_count() for m in masks) >= 30


def test_simhash_groups(spark, docs, empty):
    from xxhash import xxh64_intdigest

    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(12)]
    values = [s ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(30)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (simhash.LIMIT, 2):
        got = {x.node: x.root for x in components.components(simhash.links(table, 4, limit)).collect()}
        up = {v: v for v in values}
        for _ in values:
            new = {v: min(up[w] for w in values if ((v ^ w) & (1 << 64) - 1).bit_count() <= 4) for v in values}
            if new == up:
                break
            up = new
        assert {v: got.get(v, v) for v in values} == up
    t = "A b C d  E\tf"
    h = [xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d e", b"c d e f")]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5)
    assert simhash.fingerprint("É x") == xxh64_intdigest("É x".encode(), 42) and simhash.fingerprint(None) == 0
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    told = {r.doc_id: r.fingerprint for r in simhash.digest(own).collect()}
    for r in own.collect():  # each bit by its majority, shingle by shingle
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").encode().split()
        hs = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        assert told[r.doc_id] == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"
    rows = simhash.digest(docs).collect()
    assert len(rows) == 12 and {x.component_id for x in rows if x.fingerprint == "0" * 16} == {3}
    assert [x.component_id for x in rows if x.doc_id == 2] == [1, 1] and simhash.digest(empty).count() == 0


# -- 8


def test_code_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype("<u4")
        assert (tokenstore.unpack(*tokenstore.pack(x), n) == x).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want, at = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(tokenstore.digest(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    sums = {}
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        sums.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in sums[r.doc_id] and r.start == at
        at += r.n_tokens
        want.append(r)
    assert tokenstore.digest(empty, tokenizer_path()).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    tok, enc, r = Tokenizer.from_file(tokenizer_path()), tokenstore.Encoder(tokenizer_path()), random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "\x1c", "«", "中", "😀", " word", "Word.", " ", "\u0085", "<|endoftext|>", "½", "x" * 60]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    assert enc.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, enc.kind).tobytes() for t in texts]


def test_pieces_that_share_a_hash():
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2^64."""
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), tokenstore.Encoder(tokenizer_path())
    texts = [f"start {''.join(two[i.bit_count() & 1] for i in range(n))} end" for n in (256, 1024, 2048, 4096) for two in ("ab", "ba")]
    assert enc.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, enc.kind).tobytes() for t in texts]
    made = tokenstore._keys
    for key in (0, 5):  # keys without any worth: every piece shares one, or its length's
        tokenstore._keys = lambda buf, s, e: (np.minimum(e - s, key).astype(np.uint64), *made(buf, s, e)[1:])
        try:
            assert tokenstore.Encoder(tokenizer_path()).encode(texts) == enc.encode(texts)
        finally:
            tokenstore._keys = made


def test_pieces_that_differ_are_told_apart():
    r = random.Random(8)
    for n in (1, 7, 8, 9, 16, 17, 40):
        a = bytes(r.randrange(256) for _ in range(n))
        for i in range(n):
            b = bytearray(a)
            b[i] ^= 1
            buf, s, e = a + bytes(b) + a + bytes(8), np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
            keys, head, tail = tokenstore._keys(buf, s, e)
            assert keys[0] == keys[2] and keys[0] != keys[1] and tokenstore._same(buf, s, e, head, tail, np.array([0, 1, 0]))
            assert not tokenstore._same(buf, s, e, head, tail, np.array([0, 0, 0]))
    made = [bytes(r.choice(b"endtgab") for _ in range(n)) for n in (8, 9, 12, 16) for _ in range(20_000)]
    ends = np.cumsum([len(x) for x in made])
    keys = tokenstore._keys(b"".join([*made, bytes(8)]), np.append(0, ends[:-1]), ends)[0]
    assert len(set(keys.tolist())) == len(set(made))


# -- 9


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "WIDE", 24)
    monkeypatch.setattr(embeddings, "CELL", 20)
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 8))
    v = [(base[i % 40] + r.normal(size=8) * 0.12).astype(np.float32).tolist() for i in range(400)] + [base[0].tolist()] * 30
    v += [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)] + [(0, v[0], 1), (None, v[1], 1)], "vec_id long, embedding array<float>, label int")
    rows = [(x.vec_id, x.embedding) for x in table.collect()]
    fine = [bool(e) and all(c is not None and np.isfinite(c) for c in e) and any(e) for _, e in rows]

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if i == j or not (fine[i] and fine[j]) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95

    near = [[j for j in range(len(rows)) if linked(i, j)] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    low = {}
    for i, (vid, _) in enumerate(rows):
        low[root[i]] = min([x for x in (low.get(root[i]), vid) if x is not None], default=None)
    key = lambda t: tuple(-1 if x is None else x for x in t)
    want = sorted((key((vid, len(near[i]), low[root[i]])) for i, (vid, _) in enumerate(rows)))
    got = embeddings.near_duplicates(table).collect()
    assert sorted(key((x.vec_id, x.n_links, x.component_id)) for x in got) == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embedding_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    x = embeddings.unit(rows.values())
    want = ((x @ x.T) >= 0.95).sum() - len(x)
    got = sum(r.n_links for r in embeddings.near_duplicates(table).collect())
    assert 0.999 * want <= got <= want


@pytest.mark.parametrize("latent", [2, 3, 4])
def test_embedding_links_of_low_dimensional_vectors(spark, monkeypatch, latent):
    monkeypatch.setattr(embeddings, "CELL", 40)
    r = np.random.default_rng(latent)
    x = embeddings.unit(embeddings.unit(r.normal(size=(2400, latent + 1))) @ r.normal(size=(latent + 1, 64)) + 0.02 * r.normal(size=(2400, 64)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {y.vec_id: y.n_links for y in embeddings.near_duplicates(table, cosine=0.99).collect()}
    assert got == dict(enumerate(((x @ x.T >= 0.99).sum(axis=1) - 1).tolist()))


# -- 10


def test_trigram_queries():
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        assert (secrets.trigram_query(rule.pattern) is True) == (rule.kind == "hex")
    q = secrets.trigram_query("ab(cd|ef)+g?hij")
    assert q[0] == "and" and {"hij", "abc", "bef"} <= secrets.query_trigrams(q)


def test_secret_scan(spark, docs, empty):
    r = random.Random(6)
    parts = ["password", "PassWord", "secret", "token", "api_key", "apikey", "API-key", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "ſecret", "-", "ghp_", "A1b2" * 9, ".", "AIza" + "x" * 35]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [None, "", "token=token=abcdefg", "secret: token: abcdefgh", "x" * 30000 + " password=hunter22"]
    got = {x.doc_id: x for x in secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = []
        for k, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
            for m in re.finditer(rule.pattern, t or "", re.A | (re.I if rule.fold else 0)):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), k, m.end()))
        kinds = [x.kind for x in secrets.BASE_RULES + secrets.MORE_RULES]
        say = lambda ss: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(ss))
        assert got[i].spans == say(spans), (i, t)
        base = [x for x in spans if x[1] < 3]
        assert got[i].base_sha256 == hashlib.sha256(say(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
    assert secrets.digest(docs).count() == 12 and secrets.digest(empty).count() == 0
    assert secrets.scan(docs).columns == [*docs.columns, "spans"]
    with pytest.raises(ValueError):
        secrets.scan(docs.withColumn("Spans", F.lit(1)))


def test_postings_serve_other_rules(spark, docs):
    table = spark.createDataFrame([(1, "a token = abcdefgh"), (2, "AKIA" + "Q" * 20), (3, "nothing"), (4, None), (5, "a token = abcdefgh")], "doc_id long, text string")
    posts = secrets.index(table)
    assert posts.groupBy("gram", "key").count().where("count > 1").count() == 0 and posts.where("gram = 'tok'").count() == 1
    for rules in (secrets.BASE_RULES, secrets.BASE_RULES[1:], secrets.BASE_RULES[2:], secrets.BASE_RULES + secrets.MORE_RULES):
        want = {r.doc_id: r.spans for r in secrets.scan(table, rules=rules).collect()}
        assert {r.doc_id: r.spans for r in secrets.scan(table, rules=rules, posts=posts).collect()} == want
    assert secrets.index(docs.limit(0)).count() == 0
