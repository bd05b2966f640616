"""License scans with ordered signature rules, in built-in expressions only.

A text goes on if it has a keyword of some rule, and what else all matches of that rule contain (license_rules.always_has), or
the like of a base phrase. Its words are joined, each with its number, so that a match tells where
it begins and ends: `mit~4 license~5`. Of some hundred rules (license_rules) those whose keyword the text contains are
matched. A detection is suppressed if one of the same or a stronger priority covers its words; with equal words the
stronger one, then the first rule, stays. Labels of the detections that stay are joined by those of the base phrases,
which nothing suppresses.

Defined results: null counts as empty text, without words and labels; repeated rows each give a row; texts are read whole.
There is no shuffle; suppression goes through a text's detections in blocks of BLOCK.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, plain
from .license_rules import NEGATED, STEM, Rule, rules

#: (label, phrase) that are found at every place.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Score of the best detection by priority, and of base phrases alone.
SURE = (1.0, 0.9, 0.7, 0.5)
BASE_SURE = 0.5
BLOCK = 128
_NUMBER = r"~\d+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern(text: str) -> str:
    """The rule's regex over numbered words."""
    letters = [part.replace(" ?", "(?: )?").replace(" ", _NUMBER + " ") for part in text.split("[^ ~]")]
    return f"(?<= )(?:{'[^ ~]'.join(letters)}){_NUMBER}(?= )"


def keywords(table: list[Rule]) -> dict[str, list[str]]:
    """By what a match has besides: keywords of which any text with a detection or a base phrase contains one when its words are numbered."""
    out: dict[str, set[str]] = {}
    for r in table:
        out.setdefault(r.also, set()).update(r.keyword.split("|"))
    for _, phrase in BASE:
        out.setdefault(STEM if STEM in phrase else "", set()).add(f" {phrase.split()[0]}~")
    return {also: sorted(keys) for also, keys in out.items()}


def _any(lower: Column, keys: list[str]) -> Column:
    """Whether the raw text in lower case has one of the keywords, each of which is within one word."""
    inside = {k for k in keys if k == k.strip(" ~")}
    loose = [k for k in sorted(inside) if not any(x in k for x in inside - {k})]
    whole = sorted({k.strip(" ~") for k in keys} - inside)
    edge = WORD[:-1].replace("[^", "[")
    tests = [F.contains(lower, F.lit(k)) for k in loose] + [F.contains(lower, F.lit(k)) & lower.rlike(f"(?:^|{edge}){k}(?:$|{edge})") for k in whole]
    return reduce(or_, tests)


def _gate(lower: Column, table: list[Rule]) -> Column:
    """Whether any rule or base phrase can match: a keyword of a rule is there, and with it what else the rule needs."""
    tests = []
    for also, keys in sorted(keywords(table).items()):
        tests.append(F.contains(lower, F.lit(also)) & _any(lower, keys) if also else _any(lower, keys))
    return reduce(or_, reversed(tests))


def _numbered(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w, i: F.concat(w, F.lit("~"), i.cast("string")))
    return F.translate(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), _UPPER, _LOWER)


def _first(match: Column) -> Column:
    return F.regexp_extract(match, r"~(\d+)", 1).cast("int")


def _last(match: Column) -> Column:
    return F.regexp_extract(match, r"~(\d+)$", 1).cast("int")


def _detections(numbered: Column, table: list[Rule]) -> Column:
    groups: dict[tuple[str, str], list] = {}
    for k, r in enumerate(table):
        groups.setdefault((r.keyword, r.also), []).append({"regex": pattern(r.text), "label": r.label, "priority": r.priority, "rule": k})
    spelled = [{"keywords": words.split("|"), "also": also, "rules": own} for (words, also), own in groups.items()]
    listed = F.from_json(F.lit(json.dumps(spelled)), "array<struct<keywords:array<string>,also:string,rules:array<struct<regex:string,label:string,priority:int,rule:int>>>>")  # folded to a constant
    tried = F.flatten(F.transform(F.filter(listed, lambda g: F.contains(numbered, g["also"]) & F.exists(g["keywords"], lambda k: F.contains(numbered, k))), lambda g: g["rules"]))

    def found(r: Column) -> Column:
        return F.transform(F.regexp_extract_all(numbered, r["regex"], F.lit(0)), lambda m: F.struct(_first(m).alias("first"), (-_last(m)).alias("last"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(tried, found)))


def _suppressed(sorted_: Column) -> Column:
    """What stays of detections sorted by first word, last word falling, and priority. `last` is held with a minus sign."""
    tiers = range(len(SURE))
    kind = "array<struct<first:int,last:int,priority:int,rule:int,label:string>>"

    def block(all_: Column, reach: Column, b: Column) -> Column:
        # reach: for each priority the last words of the detections that strong; what came before the block covers up to their maximum
        before = [F.coalesce(F.array_max(F.slice(reach[f"r{p}"], F.lit(1), b * BLOCK)), F.lit(-1)).alias(f"r{p}") for p in tiers]
        start = F.struct(*before, F.array().cast(kind).alias("kept"))

        def step(a: Column, d: Column) -> Column:
            end = -d["last"]
            covered = F.lit(False)
            for p in tiers:
                covered = covered | ((d["priority"] >= p) & (a[f"r{p}"] >= end))
            grown = [F.when(d["priority"] == p, F.greatest(a[f"r{p}"], end)).otherwise(a[f"r{p}"]).alias(f"r{p}") for p in tiers]
            return F.struct(*grown, F.when(covered, a["kept"]).otherwise(F.concat(a["kept"], F.array(d))).alias("kept"))

        return F.aggregate(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)), start, step, lambda a: a["kept"])

    def tier(all_: Column, p: int) -> Column:
        return F.transform(all_, lambda d: F.when(d["priority"] == p, -d["last"]).otherwise(F.lit(-1)))

    def whole(all_: Column) -> Column:
        reach = F.struct(*[tier(all_, p).alias(f"r{p}") for p in tiers])
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return let(reach, lambda r: F.flatten(F.transform(blocks, lambda b: block(all_, r, b))))

    return F.when(F.size(sorted_) == 0, F.array().cast(kind)).otherwise(let(sorted_, whole))


def license_scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """row (struct of the columns keep), n_words, base (first, label of each base phrase's places) and detections (first, last, priority, rule, label)."""
    docs, table = plain(docs), table or rules()
    whole = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    row = F.struct(*[docs[f"`{n}`"] for n in keep or docs.columns]).alias("row")
    lowered = docs.select(row, whole.alias("whole"), F.lower(whole).alias("lower"))
    gate = _gate(F.col("lower"), table)
    gated = lowered.select("row", F.regexp_count("whole", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, _numbered(F.col("whole"))).alias("numbered"))

    def places(label: str, phrase: str) -> Column:
        return F.transform(F.regexp_extract_all("numbered", F.lit(pattern(phrase)), F.lit(0)), lambda m: F.struct(_first(m).alias("first"), F.lit(label).alias("label")))

    phrases = [places(label, phrase) for label, phrase in BASE]
    none = lambda kind: F.array().cast(kind)
    at = F.col("numbered").isNotNull()
    found = gated.select("row", "n_words", F.when(at, F.concat(*phrases)).otherwise(none("array<struct<first:int,label:string>>")).alias("base"), F.when(at, _detections(F.col("numbered"), table)).otherwise(none("array<struct<first:int,last:int,priority:int,rule:int,label:string>>")).alias("all"))
    kept = F.transform(_suppressed(F.col("all")), lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("last"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    return found.select("row", "n_words", "base", kept.alias("detections"))


def summary(found: DataFrame) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections. Denied grants count as detections, but are no labels and no score."""
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    granted = F.filter("detections", lambda d: d["label"] != NEGATED)
    base, more = F.col("base.label"), granted["label"]
    best = F.get(F.array(*map(F.lit, SURE)), F.array_min(granted["priority"]))
    score = F.when(F.size(granted) > 0, best).when(F.size("base") > 0, F.lit(BASE_SURE)).otherwise(F.lit(0.0))
    return found.select(
        "row", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").cast("long").alias("first_word"), F.array_max("base.first").cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(base, more).alias("labels"), score.alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
