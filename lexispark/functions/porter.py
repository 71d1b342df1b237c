"""The Porter stemmer as column expressions, and as SQL.

Letters become a mask of V and C, so that the measure of a stem is the number
of V+C+ runs in a prefix of the mask. The stemmer is meant for the distinct
words of a collection.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published suffix rules.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def mask(w: Column) -> Column:
    """V for a vowel, C for a consonant; y is a consonant at the start and after a vowel."""
    m = F.regexp_replace(F.regexp_replace(w, "[aeiou]", "V"), "[b-df-hj-np-tv-xz0-9]", "C")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "^y", "C"), "Cy", "CV"), "Vy", "VC")
    one = lambda a, c: F.concat(a, F.when(c != "y", c).when(a.endswith("C"), F.lit("V")).otherwise(F.lit("C")))
    return F.when(m.contains("yy"), F.aggregate(F.split(m, ""), F.lit(""), lambda a, c: F.when(c == "", a).otherwise(one(a, c)))).otherwise(plain)


class _Word:
    """Conditions on a word ``w`` with mask ``m``, less its last ``cut`` letters."""

    def __init__(self, w: Column, m: Column, cut: int = 0) -> None:
        self.w = F.substring(w, F.lit(1), F.length(w) - cut) if cut else w
        self.m = F.substring(m, F.lit(1), F.length(m) - cut) if cut else m

    def measure(self) -> Column:
        return F.size(F.regexp_extract_all(self.m, F.lit("V+C+"), F.lit(0)))

    def vowel(self) -> Column:
        return self.m.contains("V")

    def double(self) -> Column:
        return (F.length(self.w) > 1) & (F.right(self.w, F.lit(1)) == F.substring(self.w, -2, 1)) & self.m.endswith("C")

    def cvc(self) -> Column:
        return self.m.endswith("CVC") & ~F.right(self.w, F.lit(1)).isin("w", "x", "y")


def _rules(df: DataFrame, rules: dict[str, str], least: int, every: bool) -> DataFrame:
    """Apply a table of suffixes to ``_w`` by its mask, which only words with one of them have.

    The longest suffix that matches is found by one pattern and looked up in a
    map, so that a step has one measure and not one for each rule. If ``every``,
    a suffix whose condition fails leaves its turn to the next shorter one that
    ends it; the rules' order is the same.
    """
    w, m = F.col("_w"), F.col("_m")
    new = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    shorter = {x: max((y for y in rules if x != y and x.endswith(y)), key=len, default="") for x in rules}
    after = F.create_map(*(F.lit(x) for pair in shorter.items() if pair[1] for x in pair)) if any(shorter.values()) else None
    df = df.withColumn("_s", F.regexp_extract("_w", f"(?:{'|'.join(rules)})$", 0)).withColumn("_old", w).withColumn("_done", F.lit(False))
    df = df.withColumn("_m", F.when(F.col("_s") != "", mask(w)))
    depth, at = 1, set(rules)
    while every and (at := {shorter[x] for x in at if shorter[x]}):
        depth += 1
    for turn in range(depth):
        cut = F.length("_old") - F.length("_s")
        good = (F.col("_s") != "") & (F.size(F.regexp_extract_all(F.substring(m, F.lit(1), cut), F.lit("V+C+"), F.lit(0))) > least)
        if "ion" in rules:
            good = good & ((F.col("_s") != "ion") | F.substring("_old", -4, 1).isin("s", "t"))
        good = ~F.col("_done") & F.coalesce(good, F.lit(False))
        df = df.withColumn("_good", good)
        df = df.withColumn("_w", F.when(F.col("_good"), F.concat(F.substring("_old", F.lit(1), cut), F.try_element_at(new, F.col("_s")))).otherwise(w)).withColumn("_done", F.col("_done") | F.col("_good"))
        if turn + 1 < depth:
            df = df.withColumn("_s", F.coalesce(F.try_element_at(after, F.col("_s")), F.lit("")))
    return df.drop("_s", "_old", "_done", "_good")


def _step1a(w: Column, m: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _Word(w, m, 2).w).when(w.endswith("ss"), w).when(w.endswith("s"), _Word(w, m, 1).w).otherwise(w)


def _step1b_cut(w: Column, m: Column) -> Column:
    """-1 where nothing more is to do, else the letters that went."""
    return F.when(w.endswith("eed"), F.lit(-1)).when(w.endswith("ed") & _Word(w, m, 2).vowel(), F.lit(2)).when(w.endswith("ing") & _Word(w, m, 3).vowel(), F.lit(3)).otherwise(F.lit(-1))


def _step1b(w: Column, m: Column, cut: Column) -> Column:
    s = _Word(F.substring(w, F.lit(1), F.length(w) - cut), F.substring(m, F.lit(1), F.length(w) - cut))
    tidy = F.when(s.w.endswith("at") | s.w.endswith("bl") | s.w.endswith("iz"), F.concat(s.w, F.lit("e"))).when(s.double() & ~F.right(s.w, F.lit(1)).isin("l", "s", "z"), F.substring(s.w, F.lit(1), F.length(s.w) - 1)).when((s.measure() == 1) & s.cvc(), F.concat(s.w, F.lit("e"))).otherwise(s.w)
    eed = w.endswith("eed") & (_Word(w, m, 3).measure() > 0)
    return F.when(cut > 0, tidy).when(eed, _Word(w, m, 1).w).otherwise(w)


def _step1c(w: Column, m: Column) -> Column:
    s = _Word(w, m, 1)
    return F.when(w.endswith("y") & s.vowel(), F.concat(s.w, F.lit("i"))).otherwise(w)


def _step5a(w: Column, m: Column) -> Column:
    s = _Word(w, m, 1)
    return F.when(w.endswith("e") & ((s.measure() > 1) | (s.measure() == 1) & ~s.cvc()), s.w).otherwise(w)


def _step5b(w: Column, m: Column) -> Column:
    s = _Word(w, m)
    return F.when(w.endswith("l") & s.double() & (s.measure() > 1), _Word(w, m, 1).w).otherwise(w)


def stem(words: DataFrame, word: str = "term", out: str = "stem", stemmer: str = "porter") -> DataFrame:
    """``words`` with a column of stems. Words of one or two letters stay as they are."""
    if stemmer == "none":
        return words.withColumn(out, F.col(word))
    every = stemmer == "porter_all"
    steps = [_step1a, None, _step1c]
    if stemmer != "weak":
        steps += [(dict(STEP2), 0), (dict(STEP3), 0), ({"ion": "", **dict.fromkeys(STEP4, "")}, 1), _step5a, _step5b]
    w, m, cut = F.col("_w"), F.col("_m"), F.col("_cut")
    df = words.withColumn("_w", F.col(word))
    ends = {_step1a: ("s",), None: ("ed", "ing"), _step1c: ("y",), _step5a: ("e",), _step5b: ("l",)}
    for step in steps:  # a select for each step, so that no expression repeats the one before
        if isinstance(step, tuple):
            df = _rules(df, *step, every)
            continue
        # Most words end as a step's rules do not; these have no mask and stay as they are.
        some = reduce(or_, (w.endswith(x) for x in ends[step]))
        df = df.withColumn("_m", F.when(some, mask(w)))
        if step is None:
            df = df.withColumn("_cut", F.when(m.isNotNull(), _step1b_cut(w, m)))
        df = df.withColumn("_w", F.when(m.isNotNull(), _step1b(w, m, cut) if step is None else step(w, m)).otherwise(w))
    # Predicates on the stem are not pushed through explode; pushed through all steps they would grow without end.
    return df.withColumn(out, F.explode(F.array(F.when(F.length(word) <= 2, F.col(word)).otherwise(w)))).drop("_w", "_m", "_cut")


def stem_sql(source: str, stemmer: str = "porter", name: str = "stems") -> str:
    """Common table expressions that end in ``name`` (term, stem) over the terms of ``source``, for DuckDB."""
    every = stemmer == "porter_all"
    m = "regexp_replace(regexp_replace(w, '[aeiou]', 'V', 'g'), '[b-df-hj-np-tv-xz0-9]', 'C', 'g')"
    m = f"regexp_replace({m}, '^y', 'C')"
    for _ in range(12):
        m = f"replace(replace({m}, 'Cy', 'CV'), 'Vy', 'VC')"
    cut = lambda n, c="w": f"substr({c}, 1, length({c}) - {n})"
    measure = lambda x: f"len(regexp_extract_all({x}, 'V+C+'))"
    double = lambda w, x: f"(length({w}) > 1 AND right({w}, 1) = substr({w}, length({w}) - 1, 1) AND right({x}, 1) = 'C')"
    cvc = lambda w, x: f"(right({x}, 3) = 'CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def rules(pairs: list[tuple[str, str, str]], least: int) -> str:
        parts = []
        for a, b, extra in pairs if every else sorted(pairs, key=lambda r: -len(r[0])):
            good = f"{measure(cut(len(a), 'm'))} > {least}{extra}"
            new = f"{cut(len(a))} || '{b}'"
            parts.append(f"WHEN ends_with(w, '{a}') AND {good} THEN {new}" if every else f"WHEN ends_with(w, '{a}') THEN CASE WHEN {good} THEN {new} ELSE w END")
        return f"CASE {' '.join(parts)} ELSE w END"

    step1a = f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END"
    went = f"CASE WHEN ends_with(w, 'eed') THEN -1 WHEN ends_with(w, 'ed') AND contains({cut(2, 'm')}, 'V') THEN 2 WHEN ends_with(w, 'ing') AND contains({cut(3, 'm')}, 'V') THEN 3 ELSE -1 END"
    sw, sm = "substr(w, 1, length(w) - c)", "substr(m, 1, length(w) - c)"
    step1b = (
        f"CASE WHEN c > 0 THEN CASE WHEN ends_with({sw}, 'at') OR ends_with({sw}, 'bl') OR ends_with({sw}, 'iz') THEN {sw} || 'e' "
        f"WHEN {double(sw, sm)} AND right({sw}, 1) NOT IN ('l', 's', 'z') THEN substr({sw}, 1, length({sw}) - 1) "
        f"WHEN {measure(sm)} = 1 AND {cvc(sw, sm)} THEN {sw} || 'e' ELSE {sw} END "
        f"WHEN ends_with(w, 'eed') AND {measure(cut(3, 'm'))} > 0 THEN {cut(1)} ELSE w END"
    )
    step1c = f"CASE WHEN ends_with(w, 'y') AND contains({cut(1, 'm')}, 'V') THEN {cut(1)} || 'i' ELSE w END"
    steps = [step1a, step1b, step1c]
    if stemmer != "weak":
        ion = f" AND right({cut(3)}, 1) IN ('s', 't')"
        steps += [rules([(a, b, "") for a, b in STEP2], 0), rules([(a, b, "") for a, b in STEP3], 0), rules([("ion", "", ion), *((x, "", "") for x in STEP4)], 1)]
        steps.append(f"CASE WHEN ends_with(w, 'e') AND ({measure(cut(1, 'm'))} > 1 OR {measure(cut(1, 'm'))} = 1 AND NOT {cvc(cut(1), cut(1, 'm'))}) THEN {cut(1)} ELSE w END")
        steps.append(f"CASE WHEN ends_with(w, 'l') AND {double('w', 'm')} AND {measure('m')} > 1 THEN {cut(1)} ELSE w END")
    if stemmer == "none":
        return f"{name} AS (SELECT term, term AS stem FROM {source})"
    parts = [f"{name}_0 AS MATERIALIZED (SELECT term, term AS w FROM {source})"]
    for i, step in enumerate(steps):
        masked = f"(SELECT *, {went if i == 1 else '0'} AS c FROM (SELECT term, w, {m} AS m FROM {name}_{i}))"
        parts.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT term, {step} AS w FROM {masked})")
    parts.append(f"{name} AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE w END AS stem FROM {name}_{len(steps)})")
    return ",\n".join(parts)
