"""Classifiers, URL verdicts, rollups, components and the pipeline."""

import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from belegwerk.llm.components import components
from belegwerk.llm.quality_classifier import quality_scores
from belegwerk.llm.token_counts import CHANGES, Rollup, maintained
from belegwerk.llm.url_filters import RULES, url_verdicts

from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"


def test_url_rules_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.COM/en/7?x=1", "https://example.com/en/8", "http://notexample.com/en/7", "https://x.net/de/1", "https://b.example.net/de/88",
        "https://org/es/", "https://x.org?y=/es/", "http://com/en/", "http://x.com/en", "https://m.cheap-pills.example.org/fr/1", "https://ab.example.org/fr/1",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_verdicts(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fits)[1] if fits else None)
        assert got[i]["verdict"] == (max(fits)[2] if fits else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert url_verdicts(pages.limit(0)).count() == 0


def test_url_trees_learn_the_labels(spark):
    good = [(f"https://site{i}.example.org/a/{i}", 0) for i in range(60)]
    bad = [(f"https://buy-now-{i}.example.org/a/b/c?id={i}&x=1", 1) for i in range(60)]
    labelled = spark.createDataFrame(good[::2] + bad[::2], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good + bad)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(pages, labelled, rules=(("block", "nowhere.test/x"),)).collect()}
    assert sum(got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(good + bad)) >= 114


def test_url_features_against_brute_force(spark):
    import math

    from belegwerk.llm.url_filters import FEATURES, _parted, features

    urls = [None, "", "nohost", "http://a.b-c.example.com/x/y//z?a=1&b=2#f?c&d", "https://1.2.3.4/", "ftp://xn--p1.de?q", "http://A-B.Example.ORG/é/ü?&", "https://" + "s" * 80 + ".net/p" * 3]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("entropy", F.lit("clash"))
    got = {r["page_id"]: r for r in features(_parted(pages), F.lit(0.25)).collect()}
    for i, u in enumerate(urls):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        found = re.search(r"\?([^#]*)", u)
        asked = found[1] if found else ""
        shares = [host.count(c) / len(host) for c in set(host)]
        want = {
            "url_chars": len(u), "host_chars": len(host), "path_chars": len(path), "depth": len([x for x in path.split("/") if x]), "labels": len(host.split(".")),
            "digit_share": sum(c in "0123456789" for c in u) / max(len(u), 1), "hyphens": host.count("-"), "entropy": -sum(x * math.log2(x) for x in shares),
            "parameters": len(asked.split("&")) if asked else 0, "query_chars": len(asked), "suffix_block_share": 0.25, "longest_label": max(map(len, host.split("."))),
        }
        assert set(want) == set(FEATURES)
        for name, value in want.items():
            assert abs(got[i][name] - value) < 1e-9, (u, name)


def test_trees_in_sql_are_the_trees(spark):
    import numpy as np

    from belegwerk.llm.url_filters import FEATURES, train

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, len(FEATURES))), 2)
    y = (x[:, 0] + x[:, 3] * x[:, 5] + rng.normal(size=400) > 0).astype(float)
    model = train(x, y)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r["i"]: r["m"] for r in rows.select("i", model.column().alias("m")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], model.margin(x)) and ((model.margin(x) > 0) == y).mean() > 0.9


def test_conflicting_and_odd_labels(spark):
    rows = [("https://a.example.org/x", 0), ("https://a.example.org/x", 1), ("https://b.example.org/y", 7), (None, 1), ("https://c.example.org/", None)]
    labelled = spark.createDataFrame(rows * 3, "url string, label int").withColumn("suffix", F.lit("clash")).withColumn("page_id", F.lit("clash"))
    pages = spark.createDataFrame([(1, "https://a.example.org/x"), (1, None)], "page_id long, url string").withColumn("label", F.lit("clash"))
    got = url_verdicts(pages, labelled).collect()
    assert len(got) == 2 and all(0 < r["score"] < 1 for r in got)
    assert url_verdicts(pages, labelled.limit(0)).where("verdict = 'allow'").count() == 2


def test_every_suffix_has_its_share(spark):
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiouyqwxz"]
    url = lambda i, s: f"https://site{i}.abcdef.{s}/a"
    bad = lambda s: int(sum(map(ord, s)) % 2)
    labelled = spark.createDataFrame([(url(100 + i, s), bad(s)) for i in range(20) for s in names], "url string, label int")
    pages = spark.createDataFrame([(k, url(500, s)) for k, s in enumerate(names)], "page_id long, url string")
    for sample in (10_000, 200):  # the shares do not depend on the sample
        got = {r["page_id"]: r["verdict"] for r in url_verdicts(pages, labelled, rules=(("block", "nowhere.test/x"),), sample=sample).collect()}
        assert [got[k] for k in range(len(names))] == ["block" if bad(s) else "allow" for s in names]


def test_quality_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    out = quality_scores(docs, labels)
    rows = {r["doc_id"]: r for r in out.join(labels.select("doc_id", "quality"), "doc_id", "left").collect()}
    assert len(rows) == docs.count()
    held = [r for d, r in rows.items() if r["quality"] is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.9
    odd = quality_scores(documents(spark, ODD), labels)
    assert odd.count() == len(ODD) and odd.where("score is null").count() == 0
    assert quality_scores(documents(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality_scores(documents(spark, []), labels).count() == 0


def test_scores_are_calibrated_and_learn_from_neighbours(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for d in range(2500):  # label 1 is likelier the more words of the first half a text has
        lean = rng.random()
        text = " ".join(rng.choice(words[:30] if rng.random() < lean else words[30:]) for _ in range(40))
        rows.append((d, text)), labels.append((d, int(rng.random() < lean**2)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_scores(documents(spark, rows), labels).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["quality"] for r in got])
    base = np.mean((y - y.mean()) ** 2)
    assert np.mean((s - y) ** 2) < 0.85 * base
    for lo, hi in ((0, 0.25), (0.25, 0.5), (0.5, 1.01)):  # reliability
        bin_ = (s >= lo) & (s < hi)
        assert bin_.sum() < 30 or abs(s[bin_].mean() - y[bin_].mean()) < 0.12
    both = labels.union(labels.select("doc_id", (1 - F.col("quality")).alias("quality")))
    torn = quality_scores(documents(spark, rows[:50]), both).collect()  # conflicting labels
    assert len(torn) == 50 and all(0 <= r["score"] <= 1 for r in torn)


def test_least_hashed_rows(spark):
    from belegwerk.llm.common import least_hashed

    rows = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = [r["id"] for r in rows.orderBy("h", "id").limit(40).collect()]
    assert [r["id"] for r in least_hashed(rows, 40, "id").collect()] == want
    assert least_hashed(rows.withColumn("h", F.lit(2**62)), 40, "id").count() == 40 and least_hashed(rows, 9000, "id").count() == 5000


def test_rollup_batches_are_idempotent(spark, tmp_path):
    image = lambda s, n: (s, "en", "v", n, n)
    first = spark.createDataFrame([(1, None, image("a", 5)), (2, None, image("b", 7)), (3, None, image(None, 1))], CHANGES)
    second = spark.createDataFrame([(1, image("a", 5), image("a", 6)), (2, image("b", 7), None)], CHANGES)
    roll = Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    assert roll.commit("1", first) and roll.commit("2/x", second) and not roll.commit("1", first) and not roll.commit("2/x", second)
    want = {("a", 1, 6), (None, 1, 1)}
    seen = lambda: {(r["source"], r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()}
    assert seen() == want
    roll.compact()
    assert seen() == want and not roll.commit("1", first)
    assert roll.commit("3", spark.createDataFrame([(9, None, image("a", 4))], CHANGES)) and ("a", 2, 10) in seen()


def test_batches_committed_meanwhile_count_once(spark, tmp_path):
    image = lambda n: ("a", "en", "v", n, n)
    batch = lambda i: spark.createDataFrame([(i, None, image(100 + i))], CHANGES)
    roll, other = Rollup(spark, str(tmp_path / "r")), Rollup(spark, str(tmp_path / "r"))
    roll.commit("1", batch(1)), roll.commit("2", batch(2))
    real = roll._sums

    def late(folders):  # another writer commits after the listing
        other.commit("3", batch(3))
        return real(folders)

    roll._sums = late
    roll.compact()
    roll._sums = real
    seen = lambda: [(r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()]
    assert seen() == [(3, 306)] and not roll.commit("3", batch(3)) and not roll.commit("1", batch(1))
    # two writers of one batch, both past the look-up, and a fold of each
    roll._done = lambda folder: None
    assert roll.commit("4", batch(4)) and other._done("batches/4") and roll.commit("4", batch(4))
    del roll._done
    assert seen() == [(4, 410)]
    roll.compact(), other.compact()
    assert seen() == [(4, 410)] and roll.commit("5", batch(5)) and seen() == [(5, 515)]
    # what a broken attempt left is not read
    spark.createDataFrame([("a", "en", "v", 1, 1, 1)], roll.totals().schema).write.parquet(str(tmp_path / "r/batches/6/broken"))
    (tmp_path / "r/batches/6/broken/_SUCCESS").unlink()
    assert seen() == [(5, 515)] and roll.commit("6", batch(6)) and seen() == [(6, 621)]


def test_maintained_totals(spark, tmp_path):
    rows = [*ODD, (9, "a b")]
    got = maintained(documents(spark, rows), str(tmp_path / "t")).first()
    from belegwerk.llm.tokens import encoder

    tok = encoder("word_bpe_49k.json").tokenizer
    full = [t for _, t in rows if t]
    assert got["n_docs"] == len(full) and got["n_tokens"] == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in full)
    assert maintained(documents(spark, []), str(tmp_path / "u")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[95] == got[100] == 90
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def quality_by_brute_force(text):
    from belegwerk.llm.quality_rules import RULES, STOP_WORDS

    from .helpers import words
    from .test_text_ops import repeated

    w, t = words(text), text or ""
    n, lines = max(len(w), 1), [x for x in t.split("\n") if words(x)]
    upper, small = (sum(c in a for c in t) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    m = {
        "mean_word_chars": sum(map(len, w)) / n, "symbols_per_word": sum(c in "#*$%&|<>" for c in t) / n, "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "stop_word_share": sum(x.lower() in STOP_WORDS for x in w) / n, "upper_share": upper / max(upper + small, 1), "mark_share": t.count("!") / n,
    }
    broken = [r for r in RULES if len(w) >= r.from_words and (r.least is not None and m[r.measure] < r.least or r.most is not None and m[r.measure] > r.most)]
    return len(w) >= 10 and 100 * repeated(w) <= 20 * len(w) and not broken


def test_run_against_brute_force(spark, tmp_path):
    import random
    import zlib as z

    import numpy as np

    from belegwerk.llm.tokens import encoder

    from .helpers import cut_windows, near_groups, words

    rng = random.Random(12)
    stock = "the of and to in is that for it as with was by on are".split()
    text = lambda n: " ".join(rng.choice(stock) if rng.random() < 0.4 else f"v{rng.randrange(5000)}" for _ in range(n))
    passage, copied = text(70), text(90)
    rows = [*ODD] + [(100 + i, f"{text(30)} {passage} {text(20)}") for i in range(4)] + [(200, copied), (201, copied), (202, copied + " tail"), (203, text(40) + " mail a.b@host.example.com now"), (300, passage), (15, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {d: t for d, t in rows if quality_by_brute_force(t)}
    assert 203 in kept and 1 not in kept and 12 not in kept and len(kept) >= 8
    kept = {d: t for d, t in kept.items() if near_groups(kept.items(), 5, 80)[d][1] == d} if None not in kept else kept
    assert 200 in kept and 201 not in kept and 202 not in kept
    cut = cut_windows(list(kept.items()))
    assert cut[101][1] >= 70 and cut[300][1] == 70
    kept = {d: t for d, t in kept.items() if cut[d][1] < cut[d][0]}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    tok, sequences = encoder("word_bpe_49k.json").tokenizer, {}
    for d, t in kept.items():
        pieces = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
        if cut[d][1] == 0 and d != 203:
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
            assert [r["ids_crc32"] for r in pieces] == [z.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces]
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0
    for d, t in kept.items():
        assert words(t)


def test_stages_take_odd_and_empty_tables(spark):
    docs = documents(spark, [*ODD, (7, "the same id with another text"), (9, ODD[8][1])]).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert (out.count() > 0 or name == "quality_rules") and stage(spark, docs.limit(0), SF).count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_pipeline_stages(spark):
    from .helpers import cut_windows, near_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            assert 0 < len(after) < len(before) and all(before[d] == t for d, t in after.items())
        if name == "near_dedup":
            assert set(after) == {d for d, (_, c) in near_groups(before.items(), 5, 80).items() if d == c}
        if name == "substring_dedup":
            cut = cut_windows(list(before.items()))
            assert all(before[d] == t for d, t in after.items() if cut[d][1] == 0) and {d for d in before if d not in after} <= {d for d, c in cut.items() if c[0] == c[1]}
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
