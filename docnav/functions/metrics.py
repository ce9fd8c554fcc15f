"""Answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docnav.functions.text import clean_str, normalize_answer, strip, to_float
from docnav.functions.udfs import parse_list


def anls(prediction: Column, gold: Column, threshold: float = 0.5) -> Column:
    """Normalised similarity; 0 at or below the threshold, 1 for two empty strings."""
    longest = F.greatest(F.length(prediction), F.length(gold))
    s = 1 - F.levenshtein(prediction, gold) / longest
    return F.when(longest == 0, 1.0).when(s > threshold, s).otherwise(0.0)


def anls_single(prediction: Column, target: Column, threshold: float = 0.5) -> Column:
    """ANLS of stripped, lower-cased texts; 0 if one of them only is empty."""
    p, t = F.lower(strip(prediction)), F.lower(strip(target))
    longest = F.greatest(F.length(p), F.length(t))
    distance = F.levenshtein(p, t) / longest
    return F.when(longest == 0, 1.0).when((p == "") | (t == ""), 0.0).when(distance < threshold, 1.0 - distance).otherwise(0.0)


def _best(targets: Column, one) -> Column:
    """The best over the targets that are there; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter(targets, lambda t: t.isNotNull()), one)), F.lit(0.0))


def anls_best(prediction: Column, targets: Column, threshold: float = 0.5) -> Column:
    return _best(targets, lambda t: anls_single(prediction, t, threshold))


def _words(c: Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def f1_single(prediction: Column, target: Column) -> Column:
    """Token F1 over multisets of words."""
    p, t = _words(prediction), _words(target)
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(t, w)))
    none = (F.size(p) == 0) | (F.size(t) == 0)
    return F.when(none, (F.size(p) == F.size(t)).cast("double")).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(t)))


def f1_best(prediction: Column, targets: Column) -> Column:
    return _best(targets, lambda t: f1_single(prediction, t))


def exact_match(prediction: Column, targets: Column) -> Column:
    return F.coalesce(F.exists(F.filter(targets, lambda t: t.isNotNull()), lambda t: normalize_answer(t) == normalize_answer(prediction)), F.lit(False)).cast("double")


def float_equal(ref: Column, pred: Column) -> Column:
    """Equal as a number, a percentage of it or a hundredfold: within 1 % of the larger, or after rounding to 2 places."""
    close = lambda c: (F.abs(c - pred) <= 0.01 * F.greatest(F.abs(c), F.abs(pred))) | (F.round(c, 2) == F.round(pred, 2))
    return close(ref / 100) | close(ref) | close(ref * 100)


def is_exact_type(gold: Column) -> Column:
    """Addresses, file names, page numbers, dates and e-mails, which must match to the letter."""
    shapes = (r"^(https?://|www\.)", r"\.(pdf|png|jpg|csv|ipynb|py)$", r"^page \d+", r"^\d{4}-\d{2}-\d{2}$", "@")
    out = F.lit(False)
    for s in shapes:
        out |= gold.rlike(s)
    return out


def score_str(gold: Column, pred: Column) -> Column:
    g, p = clean_str(gold), clean_str(pred)
    return (
        F.when(F.lower(strip(gold)) == "not answerable", (p == "not answerable").cast("double")).when(p == "not answerable", 0.0)
        .when(is_exact_type(g), (g == p).cast("double")).otherwise(anls(p, g))
    )


def score_int(gold: Column, pred: Column) -> Column:
    """Whole numbers; decimals are cut off, not rounded."""
    whole = lambda c: to_float(c).cast("long")
    return F.coalesce((whole(gold) == whole(pred)).cast("double"), F.lit(0.0))


def score_float(gold: Column, pred: Column) -> Column:
    return F.coalesce(float_equal(to_float(gold), to_float(pred)).cast("double"), F.lit(0.0))


def score_list(gold: Column, pred: Column, gold_items: Column, pred_items: Column) -> Column:
    """Lists are sorted and compared item by item: as numbers if all of the gold ones are, else by the least similarity."""
    g, p = (F.array_sort(F.transform(c, clean_str)) for c in (gold_items, pred_items))
    numeric = F.forall(g, lambda x: to_float(x).isNotNull())
    pairs = F.arrays_zip(g.alias("g"), p.alias("p"))
    as_numbers = F.forall(pairs, lambda x: F.coalesce(float_equal(to_float(x["g"]), to_float(x["p"])), F.lit(False))).cast("double")
    as_text = F.array_min(F.transform(pairs, lambda x: anls(x["p"], x["g"])))
    return F.when(F.lower(strip(pred)) == "not answerable", 0.0).when(F.size(g) != F.size(p), 0.0).when(numeric, as_numbers).otherwise(as_text)


def eval_score(gold: Column, pred: Column, kind: Column) -> Column:
    """The rule-based score by answer format; an unknown format scores 0. Only lists are sent to the parser of lists."""
    items = lambda c: parse_list(F.when(kind == "List", c))
    return (
        F.when(kind == "Int", score_int(gold, pred)).when(kind == "Float", score_float(gold, pred)).when(kind.isin("Str", "None"), score_str(gold, pred))
        .when(kind == "List", score_list(gold, pred, items(gold), items(pred))).otherwise(0.0)
    )


def score_extracted(gold: Column, extracted: Column, kind: Column) -> Column:
    """The rules' score of an extracted answer; one that says that it failed is wrong."""
    return F.when(F.lower(strip(extracted)) == "fail to answer", 0.0).otherwise(eval_score(gold, extracted, kind))


def pick_score(mode: Column, rules: Column, judged: Column, failed: Column, judge: Column, extraction: Column) -> Column:
    """struct<score, source>: the model's score where there is one for the mode, else the rules'."""
    pair = lambda score, source: F.struct(score.alias("score"), F.lit(source).alias("source"))
    usable = judged & ~failed
    return (
        F.when(usable & mode.isin("judge", "both") & judge.isNotNull(), pair(judge, "llm_judge"))
        .when(usable & mode.isin("extract", "both") & extraction.isNotNull(), pair(extraction, "llm_extraction+rules"))
        .when(~judged, pair(rules, "rules")).otherwise(pair(rules, "rules_fallback"))
    )
