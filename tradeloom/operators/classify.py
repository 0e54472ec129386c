"""Scores to decisions: what kind a page is, list or detail, which line belongs to which field, and what is noise.

All of it works on tables of similarities, one row for each cell of a page's matrix, so any embedding can be behind them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, shapes
from . import vectors

# Floors and margins of the decisions.
HEADER_FLOOR, HEADER_SCORE, HEADER_MARGIN = 0.62, 0.10, 0.03
PAIR_FLOOR, SECTION_WEIGHT = 0.50, 0.5
IDENTIFIER_FLOOR, PRIOR_WEIGHT = 0.30, 0.15
RECOVERY_FLOOR, RECOVERY_SCORE = 0.40, 0.05
SELECT_GATE, ROLE_WEIGHT = 0.02, 0.5
ENUM_LEAD = 0.15
NAV_FLOOR, NAV_DOMAIN, NAV_SHARE, NAV_TITLE, BLOCK_FLOOR = 0.38, 0.30, 0.85, 0.40, 0.50
SHARED_FORMATS = ("Date", "TrackingCode", "Numeric")
STRICT_FORMATS = ("Date", "TrackingCode", "Numeric", "Phone", "Address", "Text")
LABEL_CAP, PREJUDICE_CAP = 48, 64


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# ---- similarities and phrase banks


def similarities(lines: DataFrame, vector: str, bank: DataFrame, most: int = 10_000) -> DataFrame:
    """Every line with every phrase of a bank (category, phrase, weight, vector) and their cosine; the bank is a dictionary and is broadcast, if it has `most` phrases at most."""
    if bank.limit(most + 1).count() > most:
        raise ValueError(f"the bank has over {most} phrases")
    b = bank.select("category", "phrase", "weight", F.col("vector").alias("_b"))
    return lines.crossJoin(F.broadcast(b)).withColumn("sim", vectors.cosine(F.col(vector), F.col("_b"))).drop("_b")


def phrase_bank(dictionary: DataFrame, prejudice: bool = False) -> DataFrame:
    """(lang, page_type, field, phrase, weight, place) from a dictionary (lang, page_type, field, kind, text).

    Labels are the semantic phrases (weight 1), then those of the bias (.92), prejudices their own (1); without examples of values,
    each once, LABEL_CAP or PREJUDICE_CAP of a field.
    """
    kinds = {"prejudice": (0, 1.0)} if prejudice else {"semantic": (0, 1.0), "bias": (1, 0.92)}
    place = reduce(lambda out, kv: out.when(F.col("kind") == kv[0], kv[1][0]), kinds.items(), F.when(F.lit(False), 0))
    weight = reduce(lambda out, kv: out.when(F.col("kind") == kv[0], kv[1][1]), kinds.items(), F.when(F.lit(False), 0.0))
    rows = dictionary.filter(F.col("kind").isin(*kinds)).select("lang", "page_type", "field", place.alias("_k"), weight.alias("weight"), F.posexplode(scalars.split_phrases(F.col("text"), 10_000)).alias("_at", "phrase"))
    keys = ["lang", "page_type", "field"]
    rows = rows.filter(~scalars.is_value_example(F.col("phrase"))).groupBy(*keys, "phrase").agg(F.min(F.struct("_k", "_at")).alias("_first"), F.max("weight").alias("weight"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")))
    return ranked.filter(F.col("place") <= (PREJUDICE_CAP if prejudice else LABEL_CAP)).select(*keys, "phrase", "weight", "place")


def poisoned(cells: DataFrame) -> DataFrame:
    """(field, phrase) of prejudice phrases that fit their own field's bank as well as any other field's.

    cells: field, phrase, bank, sim. A field without a bank of its own poisons nothing.
    """
    own = F.max(F.when(F.col("bank") == F.col("field"), F.col("sim")))
    rival = F.max(F.when(F.col("bank") != F.col("field"), F.col("sim")))
    best = cells.groupBy("field", "phrase").agg(own.alias("_own"), F.coalesce(rival, F.lit(0.0)).alias("_rival"))
    return best.filter(F.greatest("_own", F.lit(0.0)) >= F.greatest("_rival", F.lit(0.0))).filter(F.col("_own").isNotNull()).select("field", "phrase")


def span_score(bias: Column, prejudice: Column, verb: Column, words: Column) -> Column:
    """What speaks for a span less what speaks against it; long spans are held to more."""
    short = words <= 2
    return F.greatest(F.lit(0.0), bias - prejudice * F.when(short, 0.3).otherwise(0.7) - verb * F.when(short, 0.05).otherwise(0.10))


# ---- assignment of lines to fields


def header_fields(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, field, header, score): headers by their label similarity less the prejudice; one header a field. cells: doc, header, field, own, prej."""
    score = F.col("own") - F.col("prej")
    fit = cells.withColumn("score", score).filter((F.col("own") >= HEADER_FLOOR) & (score >= HEADER_SCORE))
    return vectors.exclusive_by_document(fit, doc, "field", "header", "score", HEADER_SCORE, HEADER_MARGIN)


def pair_cells(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """The scores of label and value pairs: doc, phrase, field, own, prej, section (-1 without one), fits -> score.

    A pair needs a label similarity of PAIR_FLOOR that exceeds its prejudice, and a value of the field's format (fits).
    Where several fields compete for a label that has a section, the section's lead over their mean is added by half.
    """
    kept = cells.filter((F.col("own") >= PAIR_FLOOR) & (F.col("prej") < F.col("own")) & F.col("fits"))
    there = F.when(F.col("section") >= 0, F.col("section"))
    w = Window.partitionBy(doc, "phrase")
    lead = F.when((F.count(there).over(w) > 1) & there.isNotNull(), F.col("section") - F.avg(there).over(w)).otherwise(0.0)
    return kept.withColumn("score", F.col("own") + SECTION_WEIGHT * lead)


def pair_fields(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, field, phrase, score): the strongest pairs first, one a field."""
    return vectors.exclusive_by_document(pair_cells(cells, doc), doc, "field", "phrase", "score", 0.0, 0.0, by_score=True)


def value_fits(fmt: Column, value: Column) -> Column:
    """Whether a value can be one of a field of this format; an enumeration is no amount, other formats take anything."""
    strict = fmt.isin(*STRICT_FORMATS)
    return F.when(strict, scalars.matches_format(fmt, value)).when(fmt == "Enum", ~scalars.is_numeric(value)).otherwise(F.lit(True))


def detail_cells(cells: DataFrame) -> DataFrame:
    """The cells of a detail page that may be assigned: no label lines, and enumerations only on a selected option that leads its prejudice.

    cells: doc, field, line, tag, format, selected, own, prej.
    """
    enum = F.col("format") == "Enum"
    return cells.filter(~shapes.holds_no_value(F.col("tag")) & (~enum | (F.col("selected") & (F.col("own") - F.col("prej") >= ENUM_LEAD))))


def best_identifier(candidates: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, token, href, score) of the candidate that names the record best, the first of equal ones.

    candidates: doc, place, token, href, own, prej, prior. The place in a link counts a little.
    """
    score = (F.col("own") - F.col("prej")) + PRIOR_WEIGHT * (F.col("prior") - 1.0)
    fit = candidates.withColumn("score", score).filter((F.col("own") >= IDENTIFIER_FLOOR) & (score > 0))
    best = fit.groupBy(doc).agg(F.max_by(F.struct("token", "href", "score"), F.struct("score", (-F.col("place")).alias("p"))).alias("b"))
    return best.select(doc, "b.*")


def recovered_links(candidates: DataFrame, learned: DataFrame, pattern: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, token, link): for records without a link, the labelled token that names them best, put into the learned pattern of links.

    candidates: doc, site, place, token, own, prej; learned: site and the columns of shapes.learned_shapes; pattern: site,
    head, tail, host. The token has to look like the known ones, and the link has to lead to the site's host.
    """
    score = F.col("own") - F.col("prej")
    fit = candidates.join(learned, "site", "left").filter((F.col("own") >= RECOVERY_FLOOR) & (score > RECOVERY_SCORE) & shapes.shape_allowed(F.col("token")))
    best = fit.groupBy(doc, "site").agg(F.max_by("token", F.struct(score.alias("s"), (-F.col("place")).alias("p"))).alias("token"))
    made = best.join(pattern, "site").withColumn("link", F.concat("head", "token", "tail"))
    host = scalars.url_parts(F.col("link"))[0]
    return made.filter((host == "") | (host == F.col("host"))).select(doc, "token", "link")


def single_candidates(cells: DataFrame, assigned: DataFrame, doc: str = "doc") -> DataFrame:
    """The assignment with fields added that have one line left, in the order of the fields; each takes that line from the next.

    cells: doc, field, line, score (0 or more); assigned: doc, field, line, score. A page's matrix is small by nature.
    """
    import pandas as pd

    flagged = cells.select(doc, "field", "line", "score").join(assigned.select(doc, "field", "line", F.lit(True).alias("_own")), [doc, "field", "line"], "full")

    def run(pdf):
        own = pdf["_own"].notna()
        done = {f: n for f, n in zip(pdf.loc[own, "field"], pdf.loc[own, "line"])}
        claimed, out = set(done.values()), []
        for f in sorted(set(pdf["field"]) - set(done)):
            mine = pdf[(pdf["field"] == f) & (pdf["score"] >= 0) & ~pdf["line"].isin(claimed)]
            if len(mine) == 1:
                claimed.add(mine["line"].iloc[0])
                out.append((pdf[doc].iloc[0], f, mine["line"].iloc[0], mine["score"].iloc[0]))
        return pd.DataFrame(out, columns=[doc, "field", "line", "score"])

    kinds = dict(cells.dtypes)
    added = flagged.groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, field {kinds['field']}, line {kinds['line']}, score double")
    return assigned.select(doc, "field", "line", "score").unionByName(added)


def shared_lines(cells: DataFrame, assigned: DataFrame, formats: DataFrame, values: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, field, line, score): for unassigned fields of a shared format, the best line of a field of the same format whose value fits it.

    cells: doc, field, line, score; formats: field, format; values: doc, line, value. A line without a cell scores 0.
    """
    known = formats.filter(F.col("format").isin(*SHARED_FORMATS))
    free = cells.select(doc, "field").distinct().join(assigned.select(doc, "field"), [doc, "field"], "left_anti").join(known, "field")
    given = assigned.select(doc, F.col("field").alias("_other"), "line").join(known.withColumnRenamed("field", "_other"), "_other").join(values, [doc, "line"])
    given = given.filter(scalars.matches_format(F.col("format"), F.col("value")))
    pairs = free.join(given, [doc, "format"]).join(cells.select(doc, "field", "line", "score"), [doc, "field", "line"], "left")
    best = F.max_by(F.struct("line", F.coalesce("score", F.lit(0.0)).alias("score")), F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("line")).alias("n")))
    return pairs.groupBy(doc, "field").agg(best.alias("b")).select(doc, "field", "b.line", "b.score")


def passed_values(answers: DataFrame, most_misses: int = 3) -> DataFrame:
    """(doc, field, value): the first answer of a field that is a value of its format, if no more than `most_misses` came before it.

    answers: doc, field, format, attempt (from 0), value. Tags in front are taken off; bare tags and placeholders are no values.
    """
    clean = shapes.without_markup(F.col("value"))
    good = ~shapes.is_markup(clean) & ~scalars.is_placeholder(clean) & scalars.matches_format(F.col("format"), clean)
    fit = answers.withColumn("value", clean).filter(good & (F.col("attempt") <= most_misses))
    return fit.groupBy("doc", "field").agg(F.min_by("value", "attempt").alias("value"))


def chosen_select(options: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, grp, contrast) of the select that holds the status, if it stands out.

    options: doc, grp, status, rival (similarities of an option), role_status, role_rival (of its select's label).
    """
    contrast = (F.avg("status") - F.avg("rival")) + ROLE_WEIGHT * (F.max("role_status") - F.max("role_rival"))
    groups = options.groupBy(doc, "grp").agg(contrast.alias("contrast"))
    w = Window.partitionBy(doc).orderBy(F.desc("contrast"), "grp")
    ranked = groups.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("contrast").over(w)).filter("_r = 1")
    margin = F.coalesce(F.col("contrast") - F.col("_next"), F.col("contrast"))
    return ranked.filter((F.col("contrast") > SELECT_GATE) & (margin > SELECT_GATE)).select(doc, "grp", "contrast")


# ---- noise


def is_noise(nav: Column, title: Column, domain: Column, block: Column) -> Column:
    """Whether a line is navigation, unless it is as near to what the page is about, or part of a block of navigation."""
    protected = ((domain > NAV_DOMAIN) & (domain >= nav * NAV_SHARE)) | ((title > nav) & (title > NAV_TITLE))
    return (block > BLOCK_FLOOR) | ((nav > NAV_FLOOR) & ~protected)


def title_score(sims: Column, chrome: Column) -> Column:
    """How well a title candidate names a kind of page: its greatest similarity over their mean, less what it shares with page frames."""
    most = F.greatest(F.array_max(sims), F.lit(0.0))
    mean = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / F.size(sims)
    return (most - mean) - F.greatest(chrome - most * 0.85, F.lit(0.0)) * 0.5


def column_repeats(cells: DataFrame, share: float = 0.7) -> DataFrame:
    """Texts that fill a column of a table: (doc, text, coverage, hits, state) with state drop, or keep for long or linked ones.

    cells: doc, row, col, text, linked. Tables of under three rows are left alone.
    """
    rows = cells.groupBy("doc").agg(F.count_distinct("row").alias("_rows")).filter("_rows >= 3")
    by_col = cells.groupBy("doc", "text", "col").agg(F.count("*").alias("_n"))
    hits = by_col.groupBy("doc", "text").agg(F.max("_n").alias("hits"))
    cover = cells.groupBy("doc", "text").agg(F.count_distinct("row").alias("_own"), F.bool_or("linked").alias("_linked"))
    out = cover.join(hits, ["doc", "text"]).join(rows, "doc").withColumn("coverage", F.col("_own") / F.col("_rows"))
    out = out.filter((F.col("hits") >= F.ceil(F.col("_rows") * share)) & (F.col("coverage") >= share))
    state = F.when(F.col("_linked") | (F.octet_length("text") >= 10), "keep").otherwise("drop")
    return out.select("doc", "text", "coverage", "hits", state.alias("state"))


# ---- pages


def page_scores(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, category, score): how well each kind fits a page, from its title and its lines.

    titles: doc, category, pool (of the title with the kind's phrases), only (with the kind's name), window (of the title's parts), chrome (of the
    title with page frames, the same for all kinds). lines: doc, line, category, sim, cell (whether it is a table cell).
    A title counts as far as it is about something (its lead over page frames) and says what (its lead over the next kind).
    """
    page = Window.partitionBy("doc")
    t = titles.withColumn("_a", F.col("pool") - F.avg("pool").over(page)).withColumn("_o", F.col("only") - F.avg("only").over(page))
    t = t.withColumn("_w", F.col("window") - F.avg("window").over(page))
    peak = Window.partitionBy("doc").orderBy(F.desc("_w"), "category")
    t = t.withColumn("_first", F.first("_w").over(peak.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("_second", F.coalesce(F.nth_value("_w", 2).over(peak.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    lead = clamp((F.max("pool").over(page) - F.col("chrome")) / 0.15, 0.0, 1.0)
    sure = clamp((F.greatest(F.col("_first") - F.col("_second"), F.lit(0.0)) - 0.02) / 0.08, 0.0, 1.0)
    t = t.withColumn("_trust", F.least(lead, sure)).withColumn("_e", F.exp((F.col("_a") + F.col("_o") - F.max(F.col("_a") + F.col("_o")).over(page)) / 0.05))
    t = t.withColumn("_p", F.col("_e") / F.sum("_e").over(page))

    line = Window.partitionBy("doc", "line")
    order = Window.partitionBy("doc", "line").orderBy(F.desc("sim"), "category")
    ranked = lines.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("sim").over(order), F.lit(0.0))).withColumn("_mean", F.avg("sim").over(line))
    floor, margin = F.when(F.col("cell"), 0.30).otherwise(0.38), F.when(F.col("cell"), 0.015).otherwise(0.030)
    clear = (F.col("_r") == 1) & (F.col("sim") >= floor) & (F.col("sim") - F.col("_next") >= margin) & (F.col("sim") > F.col("_mean"))
    votes = ranked.filter(clear).groupBy("doc", "category").agg(F.sum((F.col("sim") - F.col("_mean")) * F.when(F.col("cell"), 1.5).otherwise(1.0)).alias("_total"), F.count("*").alias("_n"))
    body = vectors.top_mean(lines, ["doc", "category"], "sim", "line")

    s = t.join(votes, ["doc", "category"], "left").join(body, ["doc", "category"], "left")
    n, total = F.coalesce("_n", F.lit(0)).cast("double"), F.coalesce("_total", F.lit(0.0))
    many = F.when(n > 0, F.least(F.log(n + 1) / 4.0, F.lit(1.2))).otherwise(0.0)
    proof = F.when(n < 3, n / 3.0).otherwise(1.0)
    line_signal = F.when(n > 0, total / n).otherwise(0.0) * 10.0 * many * proof
    body_signal = F.greatest(F.coalesce("top_mean", F.lit(0.0)) - F.avg(F.coalesce("top_mean", F.lit(0.0))).over(page), F.lit(0.0)) * 12.0
    title_signal = (F.greatest(F.col("_a"), F.lit(0.0)) * 15.0 + F.greatest(F.col("_o"), F.lit(0.0)) * 12.0) * F.col("_trust")
    prior = 1.0 + (0.5 + 3.0 * F.col("_p") - 1.0) * F.col("_trust")
    boost = 1.0 + (F.least(1.0 + 6.0 * F.greatest(F.col("_w"), F.lit(0.0)), F.lit(2.5)) - 1.0) * F.col("_trust")
    return s.select("doc", "category", ((title_signal + line_signal + body_signal) * prior * boost).alias("score"))


def page_type(scores: DataFrame) -> DataFrame:
    """(doc, category, score): the kind of each page; of equal ones the first by name, and none where no kind scores."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "category")
    return scores.filter("score > 0").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def periodicity(similarity: DataFrame) -> DataFrame:
    """(doc, stride, contrast): the stride of 5 or more at which a page's lines repeat best, over the mean of all strides. similarity: doc, stride, similarity."""
    mean = similarity.groupBy("doc").agg(F.avg("similarity").alias("_mean"))
    best = similarity.filter("stride >= 5").groupBy("doc").agg(F.max(F.struct("similarity", (-F.col("stride")).alias("s"))).alias("_b"))
    out = mean.join(best, "doc", "left")
    return out.select("doc", F.coalesce(-F.col("_b.s"), F.lit(0)).alias("stride"), F.greatest(F.coalesce(F.col("_b.similarity") - F.col("_mean"), F.lit(0.0)), F.lit(0.0)).alias("contrast"))


def modal_cells(rows: DataFrame) -> DataFrame:
    """(doc, tbl, cells): how many cells most rows of a table have; the least of equally many."""
    counts = rows.groupBy("doc", "tbl", "cells").agg(F.count("*").alias("_n"))
    return counts.groupBy("doc", "tbl").agg(F.max_by("cells", F.struct("_n", (-F.col("cells")).alias("c"))).alias("cells"))


def row_repetition(rows: DataFrame, most_rows: int = 30, most_tables: int = 10) -> DataFrame:
    """(doc, tbl, stride, uniformity, baseline, score): how alike the rows of a page's best list are, over the page's tables.

    rows: doc, tbl, pos (from 0), cells, vector. The first most_rows rows of the first most_tables tables of two rows or more count.
    A table of three rows and three cells is a list; its uniformity is the best mean cosine of rows 1 to 3 apart, of two pairs at least.
    The baseline is the mean over the first six rows of different tables, or of rows half the table apart where there is one table.
    """
    size = rows.groupBy("doc", "tbl").agg(F.count("*").alias("_n")).filter("_n >= 2")
    size = size.withColumn("_t", F.row_number().over(Window.partitionBy("doc").orderBy("tbl"))).filter(F.col("_t") <= most_tables)
    kept = rows.filter(F.col("pos") < most_rows).join(size.select("doc", "tbl", F.least("_n", F.lit(most_rows)).alias("n")), ["doc", "tbl"])
    lists = modal_cells(kept).filter("cells >= 3").select("doc", "tbl")
    sims = vectors.self_similarity(kept.withColumn("_key", F.struct("doc", "tbl")), "_key", "pos", "vector", range(1, 4))
    sims = sims.select("_key.doc", "_key.tbl", "stride", "similarity").join(size.select("doc", "tbl", F.least("_n", F.lit(most_rows)).alias("n")), ["doc", "tbl"])
    fit = sims.filter((F.col("n") >= 3) & (F.col("n") - F.col("stride") >= 2) & (F.col("similarity") > 0)).join(lists, ["doc", "tbl"], "left_semi")
    best = fit.groupBy("doc").agg(F.max_by(F.struct("tbl", "stride", "similarity", "n"), F.struct("similarity", (-F.col("tbl")).alias("t"), (-F.col("stride")).alias("s"))).alias("b")).select("doc", "b.*")
    few = kept.filter("pos < 6").select("doc", "tbl", "vector")
    a, b = few.alias("a"), few.alias("b")
    across = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.tbl") < F.col("b.tbl"))).groupBy(F.col("a.doc").alias("doc")).agg(F.avg(vectors.cosine(F.col("a.vector"), F.col("b.vector"))).alias("_across"))  # 60 rows a page at most
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1)).cast("int")
    own = kept.join(best.select("doc", "tbl"), ["doc", "tbl"], "left_semi")
    x, y = own.select("doc", "pos", "n", "vector").alias("x"), own.select("doc", "pos", "vector").alias("y")
    apart = x.withColumn("_to", F.col("pos") + half).alias("x").join(y, (F.col("x.doc") == F.col("y.doc")) & (F.col("x._to") == F.col("y.pos")))
    apart = apart.groupBy(F.col("x.doc").alias("doc")).agg(F.avg(vectors.cosine(F.col("x.vector"), F.col("y.vector"))).alias("_apart"))
    out = best.join(across, "doc", "left").join(apart, "doc", "left").withColumn("baseline", F.coalesce("_across", "_apart", F.lit(0.0)))
    volume = F.least(F.log1p(F.greatest(F.col("n") - 2.0, F.lit(0.0))) / 2.0, F.lit(1.2))
    return out.select("doc", "tbl", "stride", F.col("similarity").alias("uniformity"), "baseline", (F.greatest(F.col("similarity") - F.col("baseline"), F.lit(0.0)) * volume).alias("score"))


def is_detail(list_score: Column, form_score: Column, heading_list: Column, heading_form: Column, contrast: Column, repetition: Column, far_list: Column, far_form: Column, far_prejudice: Column) -> Column:
    """Whether a page shows one record: its form signals exceed its list signals; if they are within .02, the page's whole text decides."""
    gap = heading_list - heading_form
    more = contrast * 2.0 + repetition * 3.0
    damp = F.when((list_score > 0.0001) != (form_score > 0.0001), 0.5).otherwise(1.0)
    as_list = list_score * damp + F.greatest(gap, F.lit(0.0)) * 2.0 + more
    as_form = form_score * damp + F.greatest(-gap, F.lit(0.0)) * 2.0
    far_as_list = F.greatest(far_list - far_prejudice, F.lit(0.0)) + F.greatest(gap, F.lit(0.0)) * 2.0 + more
    far_as_form = F.greatest(far_form - far_prejudice, F.lit(0.0)) + F.greatest(-gap, F.lit(0.0)) * 2.0
    return F.when(F.abs(as_form - as_list) < 0.02, far_as_form > far_as_list).otherwise(as_form > as_list)


def best_selector(pieces: DataFrame) -> DataFrame:
    """(doc, selector, n): over all pieces of a page, the selector that matched most often in one; the first by name of equal ones."""
    most = pieces.groupBy("doc", "selector").agg(F.max("n").alias("n"))
    order = Window.partitionBy("doc").orderBy(F.desc("n"), "selector")
    return most.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


# ---- rows of tables


def span_groups(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pos, grp): rows of a table merged into records; a row with a rowspan takes the next ones along, whatever these span.

    rows: doc, pos, span. A table is one array and one pass over it.
    """
    listed = rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("pos", "span"))).alias("_rows"))
    start = F.struct(F.lit(-1).alias("grp"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(a, r):
        fresh = a["left"] <= 0
        grp = F.when(fresh, a["grp"] + 1).otherwise(a["grp"])
        left = F.when(fresh, F.greatest(r["span"].cast("int"), F.lit(1)) - 1).otherwise(a["left"] - 1)
        return F.struct(grp.alias("grp"), left.alias("left"), F.concat(a["out"], F.array(grp)).alias("out"))

    done = listed.withColumn("_grp", F.aggregate("_rows", start, step)["out"])
    return done.select(doc, F.explode(F.arrays_zip(F.col("_rows.pos").alias("pos"), F.col("_grp").alias("grp"))).alias("r")).select(doc, "r.pos", "r.grp")


def header_groups(rows: DataFrame, heights: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pos, grp): rows in groups as high as the table's header. rows: doc, pos; heights: doc, height (1 where there is none)."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy("pos")) - 1
    height = F.greatest(F.coalesce("height", F.lit(1)), F.lit(1))
    return rows.withColumn("_p", place).join(heights.select(doc, "height"), doc, "left").select(doc, "pos", F.floor(F.col("_p") / height).cast("int").alias("grp"))


def header_text(headers: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, at, header): the text over each column, header rows from the top joined by " > ", spans spread over their columns. headers: doc, row, col, colspan, text."""
    wide = headers.select(doc, "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest("colspan", F.lit(1)) - 1)).alias("at"), "text")
    listed = wide.groupBy(doc, "at").agg(F.sort_array(F.collect_list(F.struct("row", "text"))).alias("_t"))
    return listed.select(doc, "at", F.array_join("_t.text", " > ").alias("header"))


def headed_cells(cells: DataFrame, headers: DataFrame, doc: str = "doc") -> DataFrame:
    """Cells with the header of their column; a record of several rows takes the headers in turn. cells: doc, row, col, value; headers: doc, at, header."""
    width = headers.groupBy(doc).agg((F.max("at") + 1).alias("_w"))
    return cells.join(width, doc).withColumn("at", F.col("col") % F.col("_w")).join(headers, [doc, "at"]).drop("_w")
