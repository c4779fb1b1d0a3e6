"""Masking of chosen spans, verification and delivery, over text: a page is a text, a zone is [start, end).

Defined results. Null text stays null. Spans that overlap or meet are masked as one. Tables are joined by key columns, of
which a row of docs must be the only one with its values: where several rows share them and there are spans to mask, their
text is withheld (null), since nobody can tell whose spans they are. with_masks() needs no key. Empty tables give empty
results.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import DASHES, compact, norm, norm_all
from veilspark.operators.once import once_a_row
from veilspark.operators.stage import free_names

#: The category of zones drawn by hand, whose text is no term; the least length of a term.
BY_HAND, LEAST_TERM = "Censura Manual", 3
MARK = "█"


def item_terms(items: DataFrame) -> DataFrame:
    """doc_id, term from the items' own texts."""
    own = items.filter(~F.col("category").eqNullSafe(F.lit(BY_HAND))).select("doc_id", norm(F.col("text")).alias("term"))
    return own.filter(F.length("term") >= LEAST_TERM).distinct()


def all_terms(items: DataFrame, under: DataFrame) -> DataFrame:
    """Terms of the items and of the text under the zones (doc_id, text)."""
    more = under.select("doc_id", norm(F.col("text")).alias("term")).filter(F.length("term") >= LEAST_TERM)
    return item_terms(items).unionByName(more).distinct()


def _merged(spans: Column) -> Column:
    """Spans in order, those that meet as one."""
    zero = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), zero, step)


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced one by one, so that offsets stay; spans: array of (start, end)."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(MARK), s["end"] - s["start"])).alias("out"))

    whole = F.aggregate(_merged(spans), zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(whole)


def hit_spans(hits: Column) -> Column:
    """(start, end) of all occurrences of a row's hits."""
    each = F.transform(hits, lambda h: F.transform(h["starts"], lambda at: F.struct(at.alias("start"), (at + F.length(h["value"])).alias("end"))))
    return F.flatten(each)


def with_masks(found: DataFrame, masks: str = "masked") -> DataFrame:
    """A table with text and hits, and what its text becomes when all occurrences are masked. Nothing is shuffled."""
    return found.withColumn(masks, masked_text(F.col("text"), hit_spans(F.col("hits"))))


def masked(docs: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with the spans (keys, start, end) masked."""
    own, many, *names = free_names(docs.columns, "spans", "several", *(f"key_{k}" for k in range(len(keys))))
    per_key = spans.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.collect_set(F.struct("start", "end")).alias(own))
    twins = docs.join(per_key, _same(keys, names), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(many)).filter(F.col(many) > 1)
    twin = [f"{n}_twin" for n in names]
    per_key = per_key.join(twins.select(*(F.col(k).alias(n) for k, n in zip(keys, twin, strict=True)), F.lit(True).alias(many)), _same(twin, names), "left")
    joined = docs.join(per_key, _same(keys, names), "left")
    text = F.when(F.col(many), F.lit(None).cast("string")).otherwise(masked_text(F.col("text"), F.col(own)))
    return joined.withColumn("text", text).select(*docs.columns)


def _same(left, right) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in zip(left, right, strict=True)))


def left_under(text: Column, spans: Column) -> Column:
    """Whether something other than the mark still stands in a span."""
    left = lambda s: F.replace(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(MARK), F.lit(""))
    return F.coalesce(F.exists(spans, lambda s: left(s) != ""), F.lit(False))


def leaks_under(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kind: something other than the mark still stands in a span. Unselected occurrences elsewhere are fine."""
    at = docs.select("doc_id", "text").join(spans.select("doc_id", "start", "end"), "doc_id")
    left = F.replace(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(MARK), F.lit(""))
    return at.filter(left != "").select("doc_id", F.lit("page_text").alias("kind")).distinct()


def compact_terms(terms: DataFrame) -> DataFrame:
    """Terms (doc_id, term) without white space and dashes, those that are still long enough."""
    short = terms.select("doc_id", compact(F.col("term")).alias("term")).filter(F.length("term") >= LEAST_TERM)
    return short.distinct()


def strings_with_terms(strings: DataFrame, terms: DataFrame, ours: list[str] | None = None) -> DataFrame:
    """The strings (doc_id, place, text) that contain a term when neither counts white space and dashes. Texts that the tool
    itself wrote (ours) do not count. Where bytes can be read in several ways, each reading is a string of the place."""
    own = [re.sub(rf"[\s{DASHES}]+", "", x.casefold()) for x in ours or []]
    doc, held, dense = free_names(strings.columns, "doc", "terms", "dense")
    # the terms of a document are few; gathered, they meet each string once, and only strings that meet any are normalised
    per_doc = compact_terms(terms).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("term").alias(held))
    joined = strings.filter(F.col("text").isNotNull()).join(per_doc, F.col("doc_id") == F.col(doc)).withColumn(dense, compact(F.col("text")))
    joined = joined.filter((F.col(dense) != "") & ~F.col(dense).isin(*own) if own else F.col(dense) != "")
    hit = F.exists(held, lambda t: F.contains(F.col(dense), t))
    return joined.filter(hit).select(*strings.columns).distinct()


def hidden_term_words(hidden: DataFrame, terms: DataFrame) -> DataFrame:
    """The hidden words (doc_id, page, pos, word) that a term (doc_id, term) runs through when they stand side by side,
    normalised, in page order. Occurrences may overlap. A hidden word goes as a whole."""
    # normalised after pages have met their terms: Python in between would hide how hidden words are dealt out
    per_doc = terms.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("term").alias("terms"))
    words = F.array_sort(F.collect_list(F.struct("pos", "word")))
    pages = hidden.groupBy("doc_id", "page").agg(words.alias("words")).join(per_doc, F.col("doc_id") == F.col("_doc"))
    pages = pages.withColumn("n", norm_all(F.transform("words", lambda w: w["word"])))
    pages = pages.withColumn("words", F.zip_with("words", "n", lambda w, n: F.struct(w["pos"].alias("pos"), w["word"].alias("word"), n.alias("n"))))
    pages = once_a_row(pages.select("doc_id", "page", "words", "terms"), line=F.array_join(F.transform("words", lambda w: w["n"]), " "))
    # by a generator, since a filter would go into the join, and Python with it
    pages = once_a_row(pages, run=F.filter("terms", lambda t: F.contains(F.col("line"), t))).drop("terms")
    pages = pages.select("doc_id", "page", "words", "line", F.explode(F.when(F.size("run") > 0, F.array("run"))).alias("terms"))
    # each term's next occurrence begins at least one character after the last one
    times = lambda t: (F.length("line") - F.length(F.replace(F.col("line"), t, F.lit("")))).cast("int")
    spots = F.flatten(F.transform("terms", lambda t: F.transform(_every(F.col("line"), t, times(t)), lambda at: F.struct(at.alias("start"), (at + F.length(t)).alias("end")))))
    placed = F.aggregate(
        "words", F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<pos:int,word:string,start:int,stop:int>>)").alias("out")),
        lambda acc, w: F.struct((acc["at"] + F.length(w["n"]) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(w["pos"].cast("int").alias("pos"), w["word"].alias("word"), acc["at"].alias("start"), (acc["at"] + F.length(w["n"]) + 1).alias("stop")))).alias("out")),
        lambda acc: acc["out"],
    )
    pages = pages.select("doc_id", "page", placed.alias("words"), spots.alias("spots"))
    hit = F.filter("words", lambda w: F.exists("spots", lambda s: (w["start"] < s["end"]) & (s["start"] < w["stop"])))
    return pages.select("doc_id", "page", F.explode(hit).alias("w")).select("doc_id", "page", "w.pos", "w.word")


def _every(line: Column, term: Column, most: Column) -> Column:
    """Places, from 1, of all occurrences, overlapping ones too; most is no fewer than there are."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = F.call_function("locate", term, line, acc["at"] + 1)
        return F.when(acc["over"] | (at == 0), F.struct(acc["at"].alias("at"), F.lit(True).alias("over"), acc["out"].alias("out"))).otherwise(F.struct(at.alias("at"), F.lit(False).alias("over"), F.concat(acc["out"], F.array(at)).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), zero, step, lambda acc: acc["out"])


def leaks_in(places: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, kind for places (doc_id, kind, text) that are never seen, where any occurrence of a term is a leak."""
    near = places.select("doc_id", "kind", "text").join(terms.select("doc_id").distinct(), "doc_id", "left_semi")
    normal = near.select("doc_id", "kind", norm(F.col("text")).alias("text"))
    return normal.join(terms, "doc_id").filter(F.contains("text", F.col("term"))).select("doc_id", "kind").distinct()


#: The kind of leak that a term in a string is, by where the string stands; anywhere else it is OBJECTS. A location
#: whose mere presence is a leak; kinds that no string tells.
DETECTORS = {
    "hidden_text": "hidden_text", "form_field": "form_fields", "annotation": "annotations", "link": "links", "info": "metadata_info", "xmp": "metadata_xmp", "outline": "outline", "attachment": "attachments",
}
OBJECTS, PRESENT, SYNTAX, DEPTH = "pdf_objects", {"form": "form_fields"}, "content_syntax", "nesting_depth"


def leaks_by_location(strings: DataFrame, terms: DataFrame, ours: list[str] | None = None, broken: DataFrame | None = None, deep: DataFrame | None = None) -> DataFrame:
    """doc_id, kind, each once. strings: doc_id, location, text of all that a reader does not see, read once for all kinds; terms:
    doc_id, term, normalised. Where a location has a kind of its own, a term leaks as it stands; in any other string white
    space and dashes don't hide it. Values that the tool wrote itself (ours) do not count. broken: doc_id whose content could not be read; deep:
    doc_id nested too deep to be walked, of which nothing is known to be clean. Null text holds nothing."""
    per_doc = terms.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("term").alias("terms"))
    present = F.array(*(F.lit(x) for x in PRESENT))
    held = strings.select("doc_id", "location", "text").join(per_doc, F.col("doc_id") == F.col("d"), "left").filter(F.col("d").isNotNull() | F.array_contains(present, F.col("location")))
    normal = held.withColumn("normal", norm(F.col("text")))
    dense = lambda c: F.regexp_replace(c, rf"(?U)[\s{DASHES}]+", "")
    own = F.create_map(*(F.lit(x) for kv in DETECTORS.items() for x in kv))[F.col("location")]
    sure = F.create_map(*(F.lit(x) for kv in PRESENT.items() for x in kv))[F.col("location")]
    counts = ~F.coalesce(F.col("text").isin(*(ours or [""])), F.lit(False))
    plain = F.exists("terms", lambda t: F.contains(F.col("normal"), t))
    hidden = F.exists(F.filter(F.transform("terms", dense), lambda t: F.length(t) >= LEAST_TERM), lambda t: F.contains(dense(F.col("normal")), t))
    kind = F.when(sure.isNotNull(), sure).when(counts & own.isNotNull() & plain, own).when(counts & own.isNull() & hidden, F.lit(OBJECTS))
    found = normal.select("doc_id", kind.alias("kind")).filter("kind is not null")
    for more, name in ((broken, SYNTAX), (deep, DEPTH)):
        if more is not None:
            found = found.unionByName(more.select("doc_id", F.lit(name).alias("kind")))
    return found.distinct()


def report(docs: DataFrame, leaks: DataFrame, failed: DataFrame) -> DataFrame:
    """doc_id, verified, leaks (sorted kinds, never terms), n_failed. failed: doc_id, id, error."""
    kinds = leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("leaks"))
    fails = failed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_failed"))
    joined = docs.select("doc_id").join(kinds, "doc_id", "left").join(fails, "doc_id", "left")
    return joined.select("doc_id", F.col("leaks").isNull().alias("verified"), F.coalesce("leaks", F.array().cast("array<string>")).alias("leaks"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def delivered(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """Fail closed: a document comes out only if it was verified and no item failed; one without a report does not."""
    return docs.join(reports.filter("verified AND n_failed = 0").select("doc_id"), "doc_id", "left_semi")


REPORT = "success boolean, verified boolean, leaks array<string>, applied bigint, failed array<struct<id:string,error:string>>, text_loss_pages array<int>"


def span_error(start: Column, end: Column, text: Column) -> Column:
    """Why a span can't be masked, or null."""
    return (
        F.when(text.isNull(), F.lit("page not in document"))
        .when(start.isNull() | end.isNull(), F.lit("span not valid"))
        .when(start >= end, F.lit("span inverted or empty"))
        .when((start < 0) | (end > F.length(text)), F.lit("span off the page"))
    )


def apply(docs: DataFrame, items: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """doc_id, text (null unless delivered) and report for every document: its items masked and verified, failing closed.

    items: doc_id, id, category, text, start, end. Items that can't be masked are reported as failed, and then nothing of the
    document is delivered. Terms are the items' own texts, but for zones drawn by hand, and the text under all zones. places
    (doc_id, kind, text) are what a reader does not see; a term there is a leak, while a visible occurrence that nobody
    chose is not. Reports hold kinds of leaks, never terms. doc_id is a key of docs.
    """
    # a document's items and places are gathered once and meet it in one join each; all else happens in its row
    item = F.struct("id", "category", "text", "start", "end")
    held = items.select("doc_id", item.alias("item")).groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    rows = docs.select("doc_id", F.col("text").alias("page")).withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).join(held, "doc_id", "left")
    rows = rows.withColumn("items", F.coalesce("items", F.expr(f"cast(array() as array<{held.schema['items'].dataType.elementType.simpleString()}>)")))
    page = F.col("page")
    checked = F.transform("items", lambda i: F.struct(i.alias("item"), span_error(i["start"], i["end"], page).alias("error")))
    rows = rows.withColumn("checked", checked).withColumn("good", F.transform(F.filter("checked", lambda c: c["error"].isNull()), lambda c: c["item"]))
    spans = F.array_distinct(F.transform("good", lambda g: F.struct(g["start"].cast("int").alias("start"), g["end"].cast("int").alias("end"))))
    rows = rows.withColumn("spans", spans)
    whose = (F.col("twins") > 1) & (F.size("spans") > 0)  # nobody can tell whose spans they are
    rows = rows.withColumn("text", F.when(whose, F.lit(None).cast("string")).otherwise(masked_text(page, F.col("spans"))))
    seen = F.when(left_under(F.col("text"), F.col("spans")), F.array(F.lit("page_text"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("kinds", seen)
    if places is not None:
        chosen = F.transform(F.filter("items", lambda i: ~i["category"].eqNullSafe(F.lit(BY_HAND))), lambda i: i["text"])
        under = F.transform("good", lambda g: F.substring(page, g["start"].cast("int") + 1, (g["end"] - g["start"]).cast("int")))
        rows = rows.withColumn("raw", F.array_distinct(F.concat(chosen, under)))
        rows = rows.withColumn("terms", F.filter(norm_all(F.col("raw")), lambda t: F.length(t) >= LEAST_TERM))
        beside = places.groupBy("doc_id").agg(F.collect_list("kind").alias("place_kinds"), F.collect_list(F.coalesce("text", F.lit(""))).alias("place_texts"))
        rows = rows.join(beside, "doc_id", "left")
        # only documents with terms have their places normalised
        rows = rows.withColumn("normal", norm_all(F.when(F.size("terms") > 0, F.col("place_texts"))))
        hit = F.filter(F.arrays_zip("place_kinds", "normal"), lambda p: F.exists("terms", lambda t: F.contains(p["normal"], t)))
        rows = rows.withColumn("kinds", F.concat("kinds", F.coalesce(F.transform(hit, lambda p: p["place_kinds"]), F.array().cast("array<string>"))))
    leaks = F.sort_array(F.array_distinct("kinds"))
    failed = F.array_sort(F.transform(F.filter("checked", lambda c: c["error"].isNotNull()), lambda c: F.struct(c["item"]["id"].alias("id"), c["error"].alias("error"))))
    verified = F.size("kinds") == 0
    # masking keeps offsets, so no word outside a zone can be lost
    report = F.struct(
        verified.alias("success"), verified.alias("verified"), leaks.alias("leaks"), F.size("good").cast("long").alias("applied"),
        failed.cast("array<struct<id:string,error:string>>").alias("failed"), F.array().cast("array<int>").alias("text_loss_pages"),
    )
    return rows.select("doc_id", F.when(verified & (F.size(failed) == 0), F.col("text")).alias("text"), report.alias("report"))


def failed_messages(reports: DataFrame) -> DataFrame:
    """doc_id, messages: the errors of a report's failed items on one line, in the order of their ids."""
    return reports.select("doc_id", F.array_join(F.transform("report.failed", lambda f: f["error"]), " | ").alias("messages"))
