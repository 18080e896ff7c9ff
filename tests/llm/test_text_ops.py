"""Operators that work row by row or over word windows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from belegwerk.llm.fingerprints import fingerprints
from belegwerk.llm.near_dedup import near_duplicates
from belegwerk.llm.packing import packed, tail_cuts
from belegwerk.llm.pii import pseudonymised
from belegwerk.llm.quality_rules import quality_rules
from belegwerk.llm.sentencepiece_codec import codec, decoded, encoded
from belegwerk.llm.substring_dedup import without_repeats
from belegwerk.llm.tokens import encoder

from .helpers import LONG, ODD, cut_windows, documents, near_groups, words


def repeated(w, k=5):
    seen = {}
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_quality_rules(spark):
    rows = [*ODD, (20, "a b c d e f a b c d e g h i j\nx y\nx y\n \n\n"), (21, "### $$$ the of and to in is that for it as"), (22, "THE END!! OF!! ALL!! THE!! BIG!! WORDS!! IN!! THE!! TEXT!! IS!! HERE!!")]
    got = {r["doc_id"]: r for r in quality_rules(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, r = words(t), got[d]
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert "symbols" in got[21]["broken"] and "upper_case" in got[22]["broken"]
    assert quality_rules(documents(spark, [])).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    rows = [r for r in ODD if r[0] is not None]
    for i in range(40):  # a group of near copies, some of which only meet through others
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[-1][1]), (201, rows[-1][1].upper())]
    want = near_groups(rows, 4, 80)
    got = {r["doc_id"]: r for r in near_duplicates(documents(spark, [*rows, (None, "no id")]), k=4, percent=80).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items() if d is not None} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items() if d is not None) and got[None]["kept"]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_a_group_of_near_copies_without_its_source(spark):
    rng = random.Random(11)
    base = [f"v{rng.randrange(300)}" for _ in range(100)]
    rows = []
    for i in range(160):  # most copies link with few others: words replaced, dropped, or taken from a small stock
        w = list(base)
        for _ in range(rng.randrange(2, 7)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"z{rng.randrange(10**6)}"], [f"s{rng.randrange(4)}"]])
        rows.append((1000 - i, " ".join(w)))
    for k in (4, 5):
        want = near_groups(rows, k, 80)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows), k=k).collect()}
        assert got == want and 5 < len({c for _, c in want.values()}) < len(rows)
    # one id with two texts joins what is near either
    two = [(1, rows[0][1]), (2, LONG), (3, rows[0][1] + " x"), (3, LONG + " y"), (4, "alone " * 9)]
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, two)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_thinned_sets_share_keys(monkeypatch):
    from belegwerk.llm import near_dedup

    monkeypatch.setattr(near_dedup, "DENSE", 256)
    rng = np.random.default_rng(3)
    for n in (240, 255, 256, 300, 2000, 2047, 2050, 9000):
        for other in (n, n * 5 // 4):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            more = rng.integers(0, 2**63, other - n, dtype=np.uint64)
            b = np.unique(np.concatenate([a, more]))
            assert np.intersect1d(near_dedup.band_keys(a, 80), near_dedup.band_keys(b, 80)).size


def test_repeated_spans_against_all_windows(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    loop = "la li lu " * 40
    rows = [r for r in ODD if r[0] is not None] + [(30, loop), (31, "x " + loop)]
    for i in range(12):
        own = [f"o{i}_{j}" for j in range(rng.randrange(5, 60))]
        a, b = sorted((rng.randrange(0, 70), rng.randrange(0, 70)))
        rows.append((40 + i, " ".join(own + passage[a:b] + own[::-1] + passage)))
    rows.append((60, rows[-1][1]))
    got = {r["doc_id"]: r for r in without_repeats(documents(spark, [*rows, (None, LONG)])).collect()}
    want = cut_windows(rows)
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items() if d is not None} == want
    assert got[None]["n_removed"] == 0 and got[1]["kept_text"] is None and got[3]["kept_text"] == " \n\t "
    assert without_repeats(documents(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_cut_each(spark):
    span = " ".join(f"s{i}" for i in range(60))
    rows = [(1, span), (2, "own words here " + span), (2, "other words with no span " * 30), (3, span), (3, " ".join(f"u{i}" for i in range(80))), (4, None), (4, span + " tail")]
    docs = documents(spark, rows)
    got = without_repeats(docs, carry="row").collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["row"]["text"] or ""
        cut = r["doc_id"] > 1 and span in t
        want = " ".join(t.replace(span, "").split()) if cut else None
        assert r["n_removed"] == (60 if cut else 0) and r["kept_text"] == want and r["row"]["component"] == 1


def test_packing_holds_each_id_once(spark):
    rows = [*ODD, *[(100 + i, f"word{i} and more " * (i * 7)) for i in range(40)]]
    tokenizer = encoder("word_bpe_49k.json").tokenizer
    got = packed(documents(spark, rows).repartition(3), window=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    assert packed(documents(spark, [])).count() == 0 and tail_cuts(0, 8) == [0] and tail_cuts(13, 8) == [8, 12, 13]


def test_word_encoder_is_the_tokenizer():
    rng = random.Random(1)
    alphabet = list("abc'ABCst dlm019.,!#é É×÷ßÀÿ  é ë 한글\t\n\x0b\x1f\x00ΣΑσİſ٣½") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)] + ["", "a" * 200]
    words_ = encoder("word_bpe_49k.json")
    want = [e.ids for e in words_.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in words_.encode(pa.array(texts))] == want


def test_added_tokens_are_those_of_a_fresh_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plain text", "hello <|endoftext|> world", None, "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "", "more plain text"]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[1] == [3306, 49407, 1002]
    words_ = encoder("word_bpe_49k.json")
    assert [x.tolist() for x in words_.encode(pa.array(texts))] == want
    assert [x.tolist() for x in words_.encode(pa.array(["x", *texts])[1:])] == want
    got = {r["doc_id"]: r for r in packed(documents(spark, list(enumerate(texts)))).where("start = 0").collect()}
    assert [got[i]["doc_tokens"] for i in range(len(texts))] == [len(x) + 1 for x in want]


def test_sentencepiece_ids_and_round_trip(spark):
    coder = codec("piece_bpe_32k.model")
    rng = random.Random(2)
    alphabet = list("abcthein ABC  '.,!#é\t\n 한글▁😀\x00ﬁ½")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " "]
    want = coder.library.encode(texts, num_threads=1)
    got = list(coder.encode(texts))
    assert [x.tolist() for x in got] == want
    assert [coder.decode(x) for x in got] == coder.library.decode(want)
    out = encoded(documents(spark, ODD))
    rows = {r["doc_id"]: r for r in out.collect()}
    for d, t in ODD:
        ids = coder.library.encode(t or "", num_threads=1)
        assert rows[d]["ids"] == ids and rows[d]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    back = {r["doc_id"]: r["text"] for r in decoded(out).collect()}
    assert back[9] == "a b c d e f g h i j k l m n o p" and back[1] == ""
    assert encoded(documents(spark, [])).count() == 0


def test_viterbi_finds_the_best_sums():
    coder = codec("piece_bpe_32k.model")
    rng = random.Random(8)
    score = {coder.pieces[i]: coder.scores[i] for i in coder.ids.tolist()}
    low = coder.scores.min() - 10
    letters = "etaoinshrdlu▁é漢"
    by = {}
    for _ in range(400):
        w = "▁" * rng.randrange(2) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 24)))
        by.setdefault(len(w), []).append(w)
    for length, some in by.items():
        chars = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32).reshape(len(some), length)
        ids, counts = coder._viterbi(chars)
        ends = np.cumsum(counts)
        for w, a, b in zip(some, ends - counts, ends):
            best = [0.0]
            for end in range(1, length + 1):
                best.append(max(best[s] + score.get(w[s:end], low if end - s == 1 else -np.inf) for s in range(max(0, end - coder.width), end)))
            got = "".join(coder.pieces[i] for i in ids[a:b])
            if all(c in score for c in w):
                assert got == w and abs(sum(coder.scores[ids[a:b]]) - best[-1]) < 1e-9, w


def test_long_unspaced_words_take_linear_time():
    import time

    coder = codec("piece_bpe_32k.model")
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    start = time.time()
    texts = [text, "short and plain", None, "x" * 300 + " y"]
    got = coder.encode([t or "" for t in texts])
    assert time.time() - start < 6  # 2 s on an idle machine
    assert [x.tolist() for x in got] == coder.library.encode([t or "" for t in texts], num_threads=1)


def test_the_segment_table_grows(monkeypatch):
    from belegwerk.llm import tokens

    monkeypatch.setattr(tokens, "SLOTS", 64)
    monkeypatch.setattr(tokens, "MEMO", 100)
    small = tokens.WordEncoder("word_bpe_49k.json")
    texts = [" ".join(f"q{i}x{i * 7}" for i in range(3000)), "few words", " ".join(f"z{i}" for i in range(500)), "few words"]
    want = [e.ids for e in small.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts, want):
        assert [x.tolist() for x in small.encode(pa.array([t]))] == [w]
    assert [x.tolist() for x in small.encode(pa.array(texts))] == want


def test_texts_of_megabytes(spark):
    big = " ".join(f"w{i * i % 99991}" for i in range(300_000))
    rows = [(1, big), (2, big + " end"), (3, "z" * 1_500_000), (4, "plain words of a short text"), (5, None)]
    docs = documents(spark, rows).repartition(2)
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs).collect()}
    assert cut == {1: 0, 2: 300_000, 3: 0, 4: 0, 5: 0}
    assert {r["doc_id"]: r["text"] for r in pseudonymised(docs).collect()} == dict(rows)
    prints = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    assert prints[2]["near_next"] > 0.99 and prints[3]["fingerprint"] and prints[5]["fingerprint"] == ""
    packs = packed(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in packs) and len(packs) == 5
    assert {r["doc_id"]: r["n_words"] for r in quality_rules(docs).collect()} == {1: 300_000, 2: 300_001, 3: 1, 4: 6, 5: 0}


def test_fingerprints(spark):
    rows = [*ODD, (20, " ".join(f"a{i}" for i in range(90))), (21, " ".join(f"a{i}" for i in range(90)))]
    got = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted((d for d, _ in rows if d is not None), reverse=True)
    text = {d: t or "" for d, t in rows}
    for i, d in enumerate(order):
        t, nxt = text[d], text[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[20]["fingerprint"] == got[21]["fingerprint"] and got[21]["near_next"] == 1.0
    places = [int(x.split("@")[1]) for x in got[20]["fingerprint"].split(" ")]
    assert places == sorted(places) and max(b - a for a, b in zip(places, places[1:])) <= 12 and places[0] < 12
    assert got[None]["near_next"] == 0.0 and got[2]["fingerprint"] == ""
    assert fingerprints(documents(spark, [])).count() == 0


def kept_by_brute_force(text, gram=5, window=12):
    t = " ".join(words(text))
    if not t:
        return []
    k = gram if len(t) - len(t) // 3 >= gram else min(2, len(t))
    return [t[i : i + k] for i in range(len(t) - k + 1)], max(1, min(window, len(t) // 6))


def test_short_and_unspaced_texts_share_fingerprints_with_their_edit(spark):
    rng = random.Random(9)
    unspaced = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    texts = ["abc", "hello", "one two", "buy it now", "four words are here", "a text of some ten words that are all quite short", unspaced, unspaced[:20], "x=1;function(a,b){return a+b}" * 3, "😀é漢字" * 5 + "end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, "QZ " * 400)]
    got = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["near_edited"] > 0, t
        grams, width = kept_by_brute_force(t)
        seen = dict(x.split("@")[::-1] for x in got[i]["fingerprint"].split(" "))
        places = [int(p) for p in seen]
        assert places == sorted(places) and all(min(abs(p - s) for p in places) <= width for s in range(len(grams)))
        for p, h in seen.items():  # equal grams have equal hashes, others different ones
            assert all((h == g) == (grams[int(p)] == grams[int(q)]) for q, g in seen.items())
        for s in range(max(len(grams) - width + 1, 1)):
            assert any(s <= p < s + width for p in places)


def winnowed_by_brute_force(text, gram=5, window=12):
    """hash@place of the k-grams kept, from the definition alone."""
    import xxhash

    line = " ".join(words(text))
    n = len(line)
    if not n:
        return ""
    wide = n >= 6 * window
    k = gram if wide or n - n // 3 >= gram else min(2, n)
    width = window if wide else max(1, min(window, n // 6))
    hashes = []
    for i in range(n - k + 1):
        h = xxhash.xxh64(line[i : i + k].encode(), seed=42).intdigest()
        hashes.append(h - (1 << 64) if h >> 63 else h)
    kept = set()
    for s in range(max(1, len(hashes) - width + 1)):
        part = [(h >> 32, -(s + j)) for j, h in enumerate(hashes[s : s + width])]
        kept.add(-min(part)[1])
    return " ".join(f"{hashes[p] % (1 << 64):X}@{p}" for p in sorted(kept))


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(17)
    alphabet = list("aaaab  \n\t") + ["é", "漢", "😀", "\x85", "\u3000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 14, 15, 16, 17, 30, 47, 70, 71, 72, 73, 75, 80, 100, 105, 107, 110, 130, 200, 400]))) for _ in range(120)]
    texts += ["a" * 500, " " * 400 + "b", "x y " * 60, "ab" * 36, "", "tail " * 30 + " ", "z" * 48, "q" * 71 + " ", *(t for _, t in ODD)]
    # ids far apart, negative ones, ties
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(len(texts) - 3)} | {2**62 + 1, -(2**63), 5 << 40})
    rows = list(zip(ids, texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints(documents(spark, rows).repartition(5)).collect()}
    order = sorted((d for d, _ in rows), reverse=True)
    text = {d: t or "" for d, t in rows}
    sets = lambda f: {x.split("@")[0] for x in f.split(" ") if x}
    like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    for i, d in enumerate(order):
        t, after = text[d], text[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        own, edited = winnowed_by_brute_force(t), winnowed_by_brute_force(t[: len(t) - cut] + after[:cut])
        r = got[d]
        assert r["fingerprint"] == own, (d, t)
        assert r["edited_fingerprint"] == edited, (t, after)
        assert abs(r["near_edited"] - like(sets(own), sets(edited))) < 1e-12
        assert abs(r["near_next"] - like(sets(own), sets(winnowed_by_brute_force(after)))) < 1e-12


def test_repeated_ids_have_one_next_document(spark):
    rows = [(1, "one first text of some length"), (2, "b second text"), (2, "a second text"), (2, "c second text"), (3, "third text, " * 9), (3, "third text, " * 9)]
    got = fingerprints(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for d, t in rows if d == r["doc_id"] and len(t) == r["n_chars"])
        after = {1: "third text, " * 9, 3: "a second text", 2: rows[0][1]}[r["doc_id"]]
        if r["doc_id"] != 2:
            cut = len(t) // 3
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    one = fingerprints(documents(spark, [(7, "only one document")])).collect()[0]
    assert one["near_next"] == 1.0


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pii_keeps_formats_and_links(spark):
    card, bad = "4424350973062887", "2381604611877803"
    rows = [*ODD, (20, f"pay {card} not {bad}."), (21, f"again {card}!! on 2024-02-29, not 2024-02-30"), (22, "mail a.55@mail9.example.com from 144.137.247.239, not 300.1.1.1"), (23, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### +1 (974) 555-3436')]
    out = {r["doc_id"]: r for r in pseudonymised(documents(spark, rows)).collect()}
    for d, t in ODD:
        assert out[d]["text"] == t
    a, b = out[20]["text"].split(), out[21]["text"].split()
    assert a[1] == b[1].rstrip("!") != card and luhn(a[1]) and len(a[1]) == 16 and a[3] == bad + "."
    assert out[21]["text"].endswith("not 2024-02-30") and "2024-02-29" not in out[21]["text"]
    assert "mail9" not in out[22]["text"] and "144.137.247.239" not in out[22]["text"] and "300.1.1.1" in out[22]["text"]
    assert "24be64439e" not in out[23]["text"] and "555-3436" not in out[23]["text"] and "+1 (" in out[23]["text"]
    assert [out[d]["_kinds"] for d in (20, 21, 22, 23)] == [["card"], ["card", "date"], ["email", "ip"], ["secret", "phone"]]
    assert out[20]["kind"] == "x" and pseudonymised(documents(spark, [])).count() == 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [
        f"card {card} 12/26", f"{card.replace(' ', '')} 123 ok", f"room 12 {card} ok", f"12 {card} 123 and more", f"{card} {card}", f"no. 7 {card.replace(' ', '-')} 99 1",
        f"x {card} 2024-02-29 y", f"x {card} 123-45-6789", f"x {card} 10.1.2.3", f"x {card} 44@mail.example.com", f"3782 822463 10005 {card}", "1 " * 3000 + card,
    ]
    rows = [*enumerate(texts), (90, "12 3456 78 90 1 2"), (91, "4111 1111 1111 1112")]
    out = {r["doc_id"]: r for r in pseudonymised(documents(spark, rows)).collect()}
    new = re.search("card (.{19}) 12/26", out[0]["text"])[1]
    assert luhn(new) and new != card and re.fullmatch("[0-9]{4}( [0-9]{4}){3}", new)
    for i, t in enumerate(texts[:11]):
        got = out[i]["text"]
        assert new.replace(" ", "") in re.sub("[ -]", "", got) and not re.search("1111[ -]?1111", got), (t, got)
        if i < 6:
            assert re.sub(re.escape(card).replace("\\ ", "[ -]?"), "C", t) == re.sub(new.replace(" ", "[ -]?"), "C", got)
    assert [out[i]["_kinds"] for i in range(6, 11)] == [["card", "date"], ["card", "ssn"], ["card", "ip"], ["card", "email"], ["card", "card"]]
    assert card not in out[11]["text"] and [out[i]["text"] for i in (90, 91)] == [t for i, t in rows if i in (90, 91)]


def test_secrets_phones_dates_and_accounts_of_any_length(spark):
    long, account = "a" * 300, "DE89 3704 0044 0532 0130 00"
    texts = [
        f'password = "{long}"', 'password="abc"', "token: abcdef123456", "api_key='two words'", "the password: required field", "token" + " " * 60 + '= "x y z"', f"{'m' * 90}@{'d' * 80}.example.com",
        "call (555) 123-4567 or 555-123-4567.", "born 1850-05-05, died 0044-03-15 and 9999-12-31", f"pay to {account} now", account.replace(" ", ""), "GB82 WEST 1234 5698 7654 33", "AB12 3456 4111 1111 1111 1111", "on 2024-02-29",
    ]
    rows = list(enumerate(texts))
    docs = documents(spark, rows).withColumn("_found", F.lit("mine"))
    got = {r["doc_id"]: r for r in pseudonymised(docs).collect()}
    assert [got[i]["_kinds"] for i, _ in rows] == [["secret"]] * 4 + [[], ["secret"], ["email"], ["phone"] * 2, ["date"] * 3, ["iban"], ["iban"], [], ["card"], ["date"]]
    assert all(got[i]["_found"] == "mine" for i, _ in rows)
    assert re.fullmatch('password = "[0-9a-f]{300}"', got[0]["text"]) and re.fullmatch('password="[0-9a-f]{3}"', got[1]["text"]) and re.fullmatch("token: [0-9a-f]{12}", got[2]["text"])
    assert re.fullmatch("api_key='[0-9a-f]{9}'", got[3]["text"]) and got[4]["text"] == texts[4] and got[11]["text"] == texts[11]
    assert re.fullmatch(r"call \([0-9]{3}\) [0-9]{3}-[0-9]{4} or [0-9]{3}-[0-9]{3}-[0-9]{4}\.", got[7]["text"]) and "123-4567" not in got[7]["text"]
    a, b = re.findall(r"[0-9]{3}\)? ?-?[0-9]{3}-[0-9]{4}", got[7]["text"])
    assert re.sub("[^0-9]", "", a) == re.sub("[^0-9]", "", b)  # one number in two formats
    dates = re.findall("[0-9]{4}-[0-9]{2}-[0-9]{2}", got[8]["text"])
    assert len(dates) == 3 and not {*dates} & {"1850-05-05", "0044-03-15", "9999-12-31"} and all(not 1900 <= int(d[:4]) <= 2099 for d in dates)
    assert 1900 <= int(got[13]["text"][3:7]) <= 2100
    new = got[10]["text"]
    assert got[9]["text"].replace(" ", "") == f"payto{new}now" and new[:2] == "DE" and new != account.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert got[12]["text"].startswith("AB12 3456 ") and "1111" not in got[12]["text"]
    # other keys, other pseudonyms; no key, nothing
    other = pseudonymised(docs, "another key").where("doc_id = 13").first()["text"]
    assert other != got[13]["text"]
    from belegwerk.llm.pii import KEY_SETTING

    kept = spark.conf.get(KEY_SETTING)
    spark.conf.unset(KEY_SETTING)
    try:
        pseudonymised(docs)
        raise AssertionError("a key is needed")
    except ValueError:
        pass
    finally:
        spark.conf.set(KEY_SETTING, kept)


def test_days_are_permuted_within_the_calendar(spark):
    from belegwerk.llm.pii import DAYS, OTHER_HALVES, RECENT, RECENT_HALVES, _date

    assert OTHER_HALVES[0] * OTHER_HALVES[1] + RECENT_HALVES[0] * RECENT_HALVES[1] == DAYS
    days = [*range(0, 400), *range(RECENT - 300, RECENT + 300), *range(RECENT + 73051 - 200, RECENT + 73051 + 200), *range(DAYS - 300, DAYS)]
    rows = spark.createDataFrame([(d,) for d in days], "d int").select(F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), F.col("d")), "yyyy-MM-dd").alias("x"))
    got = rows.select("x", _date(F.col("x"), "k").alias("y")).collect()
    assert len({r["y"] for r in got}) == len(days) and all(re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", r["y"]) for r in got)


def test_feistel_is_a_bijection(spark):
    from belegwerk.llm.pii import feistel

    n = F.lit(13).cast("long"), F.lit(29).cast("long")
    got = [r["v"] for r in spark.range(13 * 29).select(feistel(F.col("id"), *n, "k", "t").alias("v")).collect()]
    assert sorted(got) == list(range(13 * 29)) and got != sorted(got)
