"""License scans, pseudonyms and toxicity."""

import itertools
import random
import re
import time
from collections import Counter
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import licenses, pii, toxicity


def test_license_scan(spark):
    mit = licenses.KNOWN[0][2]
    rows = [
        (1, "Released under the MIT License."), (2, "prose here\nLICENSED  under CC BY-NC 4.0!\nmore"), (3, "Copyright (c) 2020 A. Person\n\n" + mit.upper()),
        (4, "prose first\n\n" + mit + "\n\nprose after"), (5, None), (6, ""), (7, "This work is licenced under the GNU General Public Licence, version 3"), (7, "Copyright law is long."),
        (8, "not Released under the MIT License. at all"), (None, "(C) 1999 x\nall rights reserved\nLicensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, digest string")
    got = {(r.doc_id, r.licenses): (r.whole_license, r.n_notices, r.restricted) for r in licenses.license_scan(df).collect()}
    assert got == {
        (1, "MIT"): ("MIT", 1, False), (2, "CC-BY-NC-4.0"): (None, 1, True), (3, "MIT"): ("MIT", 0, False), (4, "MIT"): (None, 0, False), (5, ""): (None, 0, False), (6, ""): (None, 0, False),
        (7, "GPL-3.0"): ("GPL-3.0", 1, True), (7, ""): (None, 0, False), (8, ""): (None, 0, False), (None, "Apache-2.0"): ("Apache-2.0", 1, False),
    }
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_feistel_permutes():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(pii.feistel(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pseudonyms(spark):
    p = pii.Pseudonymizer(b"secret")
    good = ["und.34@mail7.example.com", "4709559030084884", "4709 5590 3008 4884", "+1 (017) 555-7713", "123-45-6789", "2024-02-29", "31/12/1999", "GB82 WEST 1234 5698 7654 32", "97.51.17.173", "555-123-4567"]
    seen = {}
    for s in good:
        new, found = p.text(f"a {s} b {s}!")
        assert sum(found.values()) == 2, s
        x, y = re.fullmatch(r"a (.+) b (.+)!", new).groups()
        assert x == y != s and re.sub(r"\d", "9", x) == re.sub(r"\d", "9", s) or "@" in s or s[:2] == "GB" or "." in s
        assert p.text(f"a {x} b")[1] == {next(iter(found)): 1}  # valid again
        seen[s] = x
    assert len(set(seen.values())) == len(good) and pii.Pseudonymizer(b"other").text(good[1])[0] != seen[good[1]]
    for s in ["9807915762804490", "666-12-3456", "2023-02-29", "300.1.1.1", "GB82 WEST 1234 5698 7654 33", "version 4.0.1", "", "no numbers"]:
        assert p.text(s) == (s, {})
    both, found = p.text("+1 (826) 555-4081 190.137.223.204 4709559030084884 12")
    assert found == {"phone": 1, "ipv4": 1, "card": 1} and both.endswith(" 12")
    df = spark.createDataFrame([(1, None, 0), (1, "x", 0), (None, "mail a.b@example.org " * 1000, 0)], "doc_id long, text string, n_found int")
    got = sorted(((r.doc_id or 0), r.text is None, r.n_found, r.n_email) for r in pii.pseudonymize(df, b"k").collect())
    assert got == [(0, False, 1000, 1000), (1, False, 0, 0), (1, True, 0, 0)]
    assert pii.pseudonymize(df.limit(0), b"k").count() == 0


CLEAN = ["the weather was mild and the river ran slow", "people walked along the shore in the morning", "a train left the station before noon", "we read the letter twice and sent a reply"]


def corpus(n=400):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        t, toxic = " ".join(rng.sample(CLEAN, 2)), int(i % 4 == 0)
        if toxic:
            w = t.split()
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grimbo", "snarkel", f"vaqux{rng.choice('abcdefgh')}{rng.choice('nmlk')}"]))
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_finds_disguises(spark):
    docs, labels = corpus()
    hidden = ["the gr1mb0 left the station", "we read s n a r k e l twice", "a grrrrimbo walked along", "the $narkel ran slow", "the g.r.i.m.b.o ran", "people vaquxzz walked"]
    docs = docs + [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, None), (2001, ""), (2002, "the weather was mild " * 3000), (2002, "the train left"), (None, "the river ran slow"), (2003, "call 555 1234 on the 3rd day")]
    df = spark.createDataFrame([(*d, 0.5, True) for d in docs], "doc_id long, text string, score double, held_out boolean")
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.predicted == 1 for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000)
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 2000)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df, lab).collect()} == {0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_trigram_counts_do_not_depend_on_pieces():
    a, b = np.zeros(toxicity.K**3, np.int64), np.zeros(toxicity.K**3, np.int64)
    texts = ["Hello wörld", None, "", "abc" * 50]
    toxicity.count_trigrams(texts, a)
    for t in texts:
        toxicity.count_trigrams([t], b)
    assert a.sum() > 0 and (a > 0).tolist() == (b > 0).tolist()


def test_large_batches_of_strings(spark):
    """More, and longer, strings than one chunk of a string column holds."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(n))
    docs = [(i, words(400) + (" grimbo" if i % 2 else "")) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    lab = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    assert {(r.doc_id % 2, r.predicted) for r in toxicity.toxicity(df, lab).collect()} == {(0, 0), (1, 1)}
    assert pii.pseudonymize(df, b"k").filter("n_found = 0").count() == 150


def test_spaced_words_at_any_boundary():
    n = np.zeros(toxicity.K**3, np.int64)
    toxicity.count_trigrams(["the idiot ran and the idiots walked by the river"] * 50, n)
    d = toxicity.Decoder(toxicity.log_probabilities(n))
    for t in ["i d i o t", "an i d i o t.", "i d i o t!", "an i d i o t, he", '"i d i o t"', "(i d i o t)", "i - d - i - o - t", "i  d  i  o  t", "the i d i o t ran", "i. d. i. o. t.", "[i_d_i_o_t]", "i d 1 0 t", "i d i o t !", "so:i d i o t;"]:
        assert any("idiot" in w.split() and apart for w, apart in d.restored(t)), t
    assert not d.restored("the idiot ran by a river") and not d.restored("a b")


def test_shorter_readings_and_phone_forms():
    p = pii.Pseudonymizer(b"secret")
    for value, after, kind in [
        ("BE68 5390 0754 7034", " IS", "iban"), ("AT61 1904 3002 3457 3201", " BIC", "iban"), ("+44 20 7946 0958", " 2019", "phone"), ("+44 20 7946 0958", " 12 men", "phone"),
        ("1-555-123-4567", " ok", "phone"), ("555 123 4567", " ok", "phone"), ("+44 20 7946 0958", "", "phone"),
    ]:
        alone, _ = p.text(value)
        assert alone != value and p.text(f"at {value}{after}") == (f"at {alone}{after}", {kind: 1})
    assert p.text("1-555-123-4567")[0][2:] == p.text("555-123-4567")[0]
    # What lies inside a candidate that is none is found.
    inside, found = p.text("AB12 1234 4709 5590 3008 4884")
    assert found == {"card": 1} and inside.startswith("AB12 1234 ")


def test_license_texts_headers_and_every_notice(spark):
    whole = {i: t for i, _, t in reversed(licenses.KNOWN) if len(t) > 5000}
    rows = [(i, t) for i, t in whole.items()] + [("Apache-2.0", 'prose\n\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n\nprose')]
    rows += [("GPL-2.0", "Released under the GNU General Public License, version 2.\nx"), ("LGPL-3.0", "x\nReleased under LGPL-3.0-only"), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3 or later.\nx"), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0\nx"), ("BSD-3-Clause", "Released under the BSD 3-Clause License\nx"), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0\nx")]
    assert set(whole) >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    for n, (i, _) in enumerate(rows):
        assert i in got[n].licenses.split(",") and got[n].whole_license == (i if n < len(whole) else None), i
        assert got[n].restricted == (i not in ("Apache-2.0", "CC0-1.0", "BSD-3-Clause")), i


def test_dates_are_permuted_within_their_form():
    """Every date of a form, in both orders of day and month, has a pseudonym of its own in the same form."""
    key = b"secret"
    for form, some in (((2, 2, 4), 200 * (365 + 365 - 144) + 2 * 49 - 0), ((1, 1, 4), 200 * 81)):
        texts = ["/".join(f"{v:0{n}d}" for v, n in zip(d, form, strict=True)) for d in pii.days_of(form)]
        assert len(set(texts)) == len(texts) == some
    day_first = {f"{d:02d}/{m:02d}/{y}" for y in (1900, 1999, 2000) for m in range(1, 13) for d in range(1, 1 + pii.monthrange(y, m)[1])}
    month_first = {f"{m:02d}/{d:02d}/{y}" for y in (1900, 1999, 2000) for m in range(1, 13) for d in range(1, 1 + pii.monthrange(y, m)[1])}
    for group in (day_first | month_first, {"1/2/2001", "9/9/2001", "7/3/1950"}, {"2024-02-29", "2024-2-29", "1950-7-3", "1950-12-3"}):
        new = {t: pii.day(t, key) for t in group}
        assert None not in new.values() and len(set(new.values())) == len(group)
        assert all(re.sub(r"\d", "9", n) == re.sub(r"\d", "9", t) for t, n in new.items())
        assert all(pii.day(n, key) is not None for n in new.values())
    for bad in ("29/02/1900", "31.04.2000", "00/01/2000", "13/13/2000", "1899-12-31", "2100-01-01", "01/02.2000"):
        assert pii.day(bad, key) is None


def brute_pii(text):
    """Found values by plain rules, for texts that hold one value between blanks at a time."""
    found = Counter()
    for w in (text or "").split(" "):
        if re.fullmatch(r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}", w):
            found["email"] += 1
        elif re.fullmatch(r"\d{4}-\d\d-\d\d", w):
            try:
                found["date"] += 1900 <= date.fromisoformat(w).year < 2100
            except ValueError:
                pass
        elif re.fullmatch(r"\d+(\.\d+){3}", w):
            found["ipv4"] += all(int(x) < 256 and str(int(x)) == x for x in w.split("."))
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}", w):
            found["ssn"] += not (w[:3] in ("000", "666") or w[0] == "9" or w[4:6] == "00" or w[7:] == "0000")
        elif re.fullmatch(r"\d{16}", w):
            digits = [int(c) for c in w]
            total = sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::2])
            found["card"] += total % 10 == 0 and len(set(w)) > 1
    return +found


def test_pseudonyms_match_brute_force(spark):
    """What is found, that the rest stays, and that equal values stay equal and different ones different over a whole table."""
    rng = random.Random(17)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    value = [
        lambda: f"u{digits(2)}.x@mail{rng.randint(0, 3)}.example.org", lambda: f"{rng.randint(1880, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: digits(16), lambda: "plain", lambda: "v" + digits(5),
    ]
    rows = [(i, " ".join(rng.choice(value)() for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(7, None), (7, ""), (None, "x " * 100_000 + "u12.x@mail1.example.org")]
    got = pii.pseudonymize(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_date int"), b"k").collect()
    assert len(got) == len(rows)
    kinds = lambda r: {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]}
    assert sorted(str((r.doc_id, sorted(kinds(r).items()))) for r in got) == sorted(str((i, sorted(brute_pii(t).items()))) for i, t in rows)
    old, new = {i: t for i, t in rows if i != 7}, {r.doc_id: r.text for r in got if r.doc_id != 7}
    pairs = {}
    for i, t in old.items():
        assert len(t.split(" ")) == len(new[i].split(" "))
        for a, b in zip(t.split(" "), new[i].split(" "), strict=True):
            assert pairs.setdefault(a, b) == b
            assert brute_pii(a) == brute_pii(b) and (a == b or brute_pii(a))
    assert len(set(pairs.values())) == len(pairs)


def test_spellings_of_neighbours(spark):
    mit = licenses.KNOWN[0][2]
    rows = [(1, "licence licence license"), (2, "per cent per cent of the of the"), (3, "sub licence sub license non commercial"), (4, mit.replace("License", "Licence"))]
    got = {r.doc_id: r.u for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", licenses.unit(licenses.canonical_lines(F.col("text"))).alias("u")).collect()}
    assert (got[1], got[2], got[3]) == ("license license license", "percent percent of the of the", "sublicense sublicense noncommercial")
    known = (("X", "permissive", "the license license of x"),)
    found = licenses.license_scan(spark.createDataFrame([(1, "The licence, Licence of X!"), (2, "word " * 300_000), (3, None)], "doc_id long, text string"), known).collect()
    assert {r.doc_id: r.whole_license for r in found} == {1: "X", 2: None, 3: None}


def test_decoding_matches_all_paths():
    """The Viterbi search against the best of all readings of short spans."""
    n = np.zeros(toxicity.K**3, np.int64)
    toxicity.count_trigrams(["the idiot ran by a river and sat still", "a silly stone lay on the table"] * 30, n)
    logp = toxicity.log_probabilities(n)
    d, rng = toxicity.Decoder(logp), random.Random(23)

    def score(reading):
        a = b = 0
        total = 0.0
        for text, cost in reading:
            total -= cost
            for ch in text:
                c = toxicity.letter_class(ch)
                if c or b:
                    total += float(logp[a, b, c])
                    a, b = b, c
        return total

    for _ in range(150):
        span = "".join(rng.choice(["i", "d", "0", "1", "t", "$", "s", "l", ".", "*", "iii", "a", "@"]) for _ in range(rng.randint(1, 6)))
        readings = [*itertools.product(*d.options(span), [(" ", 0.0)])]
        best = max(map(score, readings))
        found = d.decode(span)
        assert any("".join(t for t, _ in r).strip() == found or re.sub(" +", " ", "".join(t for t, _ in r)).strip() == re.sub(" +", " ", found) for r in readings if score(r) > best - 1e-6), span


def test_long_spans_are_decoded_at_even_cost():
    n = np.zeros(toxicity.K**3, np.int64)
    toxicity.count_trigrams(["the idiot ran by a river and sat still"] * 30, n)
    d = toxicity.Decoder(toxicity.log_probabilities(n))
    assert d.decode("1d10t") == "idiot" and d.kept.cache_info().currsize == 1

    def seconds(signs):
        span, began = "1d10t" * (signs // 5), time.perf_counter()
        assert d.decode(span).startswith("idiotidiot")
        return time.perf_counter() - began

    few = min(seconds(20_000) for _ in range(3))
    assert seconds(400_000) < 60 * few  # twenty times the signs
    assert d.kept.cache_info().currsize == 1


def test_very_long_values_are_permuted_in_pieces(spark):
    p = pii.Pseudonymizer(b"k")
    runs = ["a" * 100_000, "a" * 99_999 + "b", "b" + "a" * 99_999, "aB3" * 5000, "7" * 10_000]
    mails = [f"{r}@example.com" for r in runs]
    out = [p.text(f"to {m}, soon")[0] for m in mails]
    assert len(set(out)) == len(mails) and not p.kept.cache_info().currsize
    for new, old in zip(out, mails, strict=True):
        assert len(new) == len(old) + 9 and new.endswith("@example.com, soon") and old not in new
        kind = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        assert kind(new[3:-6]) == kind(old)
    # Up to one piece nothing changed: the whole run is one number. Beyond it, runs that differ anywhere stay different.
    short = {pii.letters_and_digits("".join(t) + "x" * 62, b"k", "t") for t in itertools.product("abc", repeat=3)}
    assert len(short) == 27
    got = pii.pseudonymize(spark.createDataFrame([(1, mails[0] + " " + mails[0]), (2, "x" * 200_000)], "doc_id long, text string"), b"k").collect()
    a, b = next(r.text for r in got if r.doc_id == 1).split(" ")
    assert a == b == out[0][3:-6]
