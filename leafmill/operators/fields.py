"""Fields of forms: which texts are labels, which value belongs to a label, canonical names by
profile, and scores of extracted fields. Labels and values meet inside a page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.values import strip
from ..sources.tables import written
from .groups import in_groups

# Phrases that are labels without a colon.
LABELS = (
    "account", "account id", "total", "subtotal", "tax", "total due", "amount due", "amount", "balance", "balance due", "closing balance", "invoice number", "invoice no", "invoice #", "invoice", "inv no",
    "inv #", "date", "invoice date", "due", "due date", "period", "order number", "order no", "order #", "po number", "po #", "purchase order", "bill to", "ship to", "sold to", "vendor", "customer",
    "account number", "account no", "reference", "ref", "document type", "status", "priority", "company", "department", "requested by", "reviewed by", "full name", "passenger", "from", "to", "seat", "gate",
    "flight", "class", "booking", "quantity", "qty", "unit price", "price", "description", "phone", "email", "name", "address", "merchant", "store", "receipt number", "receipt no", "payment", "payment terms",
    "discount", "shipping", "grand total", "net", "gross",
)
# What labels of each type contain.
AMOUNT_WORDS = ("total", "amount", "balance", "subtotal", "tax", "price", "due", "payment", "discount")
# The fields of an invoice and of a receipt with their names, best first, and types.
INVOICE = (
    ("invoice_number", ("invoice number", "invoice no", "invoice #", "inv no", "inv #"), None), ("invoice_date", ("invoice date", "date", "issued", "issue date"), "date"), ("due_date", ("due date", "payment due", "due"), "date"),
    ("account", ("account", "account number", "account no", "account id"), None), ("reference", ("reference", "ref"), None), ("period", ("period", "statement period"), None),
    ("closing_balance", ("closing balance", "ending balance", "balance"), "amount"), ("po_number", ("po number", "po #", "purchase order", "order number", "order no"), None),
    ("vendor", ("vendor", "from", "seller", "supplier", "bill from"), None), ("bill_to", ("bill to", "billed to", "customer", "sold to"), None), ("subtotal", ("subtotal", "sub total", "net"), "amount"),
    ("tax", ("tax", "vat", "gst", "sales tax"), "amount"), ("total", ("total", "amount due", "balance due", "grand total", "total due"), "amount"),
)
RECEIPT = (
    ("merchant", ("merchant", "store", "vendor", "name"), None), ("date", ("date", "transaction date"), "date"), ("subtotal", ("subtotal", "sub total"), "amount"), ("tax", ("tax", "vat", "gst"), "amount"),
    ("total", ("total", "amount", "amount due", "grand total"), "amount"), ("payment", ("payment", "card", "paid", "tender"), None),
)
#: How sure a place is: within one text, right or left of the label, below it.
STRENGTH = {"inline": 1.0, "right": 0.9, "left": 0.9, "below": 0.75}


def strip_label(text: Column) -> Column:
    """Without colons at the end."""
    return strip(F.regexp_replace(strip(text), ":+$", ""))


def is_label(text: Column) -> Column:
    """Six words at most and a colon, or a known phrase."""
    bare = strip_label(text)
    words = F.size(F.filter(F.split(bare, "(?U)\\s+"), lambda w: w != ""))
    return (strip(text) != "") & (((bare != "") & strip(text).endswith(":") & (words <= 6)) | X.ascii_lower(bare).isin(*LABELS))


def hint(label: Column) -> Column:
    """The type of value that a label promises, or any."""
    k = X.ascii_lower(label)
    has = lambda *words: k.rlike("|".join(words))
    return (
        F.when(has("date") | (k == "due"), "date").when(has("email"), "email").when(has("phone", "tel", "fax"), "phone").when(has(*AMOUNT_WORDS), "amount")
        .when((k == "qty") | has("quantity"), "number").otherwise("any")
    )


def hinted(text: Column, of: Column) -> Column:
    """values.typed with a hint that differs from row to row."""
    return V.typed(text, of)


def neighbours(frags: DataFrame) -> DataFrame:
    """Pairs of labels and values: doc_id, page, label (idx), value (idx), place, label_text, raw and the value's confidence. A
    label takes the cheapest text that is no label: to its right on the line (by distance), to its left (1000 more), or below with
    about the same left edge (500 more); labels choose in order and a text is taken once. frags: doc_id, page, idx, text, box,
    confidence. A page is worked through in order; its fragments are few, and their texts come along, so that nothing is joined
    back."""
    schema = "doc_id long, page int, label long, value long, place string, label_text string, raw string, confidence double"

    def work(rows: list[tuple]) -> list[tuple]:
        taken, out = set(), []
        values = [(j, x0, x1, (y0 + y1) / 2, text, sure) for _, _, j, x0, y0, x1, y1, text, sure, label in rows if not label]
        for doc, page, i, ax0, ay0, ax1, ay1, label_text, _, label in rows:
            if not label or i in taken:
                continue
            height = abs(ay1 - ay0)
            slack, middle, apart = max(0.6 * height, 2.0), (ay0 + ay1) / 2, 2 * max(height, 6.0)
            best = None
            for value in values:
                j, x0, x1, y, _, _ = value
                off = y - middle
                if abs(off) <= slack:
                    if x0 >= ax1 - slack:
                        place, cost = "right", max(x0 - ax1, 0.0)
                    elif x1 <= ax0 + slack:
                        place, cost = "left", max(ax0 - x1, 0.0) + 1000
                    else:
                        continue
                elif off < -slack and abs(x0 - ax0) <= apart:
                    place, cost = "below", 500 - off
                else:
                    continue
                if (best is None or cost < best[0]) and j != i and j not in taken:
                    best = cost, place, value
            if best is not None:
                _, place, (j, _, _, _, text, sure) = best
                taken |= {i, j}
                out.append((doc, page, i, j, place, label_text, text, sure))
        return out

    src = frags.select("doc_id", "page", "idx", "x0", "y0", "x1", "y1", "text", F.col("confidence").cast("double").alias("confidence"))
    return in_groups(src, 2, schema, work, (is_label(F.col("text")).alias("is_label"),))


def spatial_fields(frags: DataFrame) -> DataFrame:
    """doc_id, page, idx (of the label), key, raw, place, the typed value and a confidence: a label without a colon counts 0.8, a text
    where a type was promised 0.6 and elsewhere 0.9, times the place's strength and the value's own confidence.
    frags: as in neighbours, with confidence."""
    j = neighbours(frags).withColumn("key", strip_label(F.col("label_text"))).withColumn("hint", hint(F.col("key"))).withColumn("raw", strip(F.col("raw")))
    j = j.withColumn("typed", hinted(F.col("raw"), F.col("hint")))
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])[F.col("place")]
    pattern = F.when(F.col("typed.kind") != "text", 1.0).when(F.col("hint") == "any", 0.9).otherwise(0.6)
    sure = F.when(strip(F.col("label_text")).endswith(":"), 1.0).otherwise(0.8) * strength * pattern * F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence")))
    return j.select("doc_id", "page", F.col("label").alias("idx"), "key", "raw", "place", "typed", sure.alias("confidence"))


def label_matches(found: Column, synonym: Column) -> Column:
    """Equal forms, the synonym's several words inside, or as many words and an edit distance of up to a sixth
    of the synonym's length, one at least."""
    a, b = X.alnum_key(F.regexp_replace(found, "\\.+$", "")), X.alnum_key(F.regexp_replace(synonym, "\\.+$", ""))
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    inside = (words(b) > 1) & F.concat(F.lit(" "), a, F.lit(" ")).contains(F.concat(F.lit(" "), b, F.lit(" ")))
    near = (words(a) == words(b)) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.length(b) / 6)))
    return (a == b) | inside | near


def apply_profile(fields: DataFrame, profile: tuple = INVOICE) -> DataFrame:
    """fields (doc_id, idx, key, raw, ...) with canonical: the profile's name, or null for fields that
    are left over; leftovers that repeat a canonical field's name and value are dropped. The profile's fields
    choose in its order: the best name, then the first field, and a field is used once. Hints keep Spark from sending out all
    fields where their files are small."""
    fields = written(fields, "fields")  # read three times
    names = [(o, key, rank, syn) for o, (key, syns, _) in enumerate(profile) for rank, syn in enumerate(syns)]
    # a few dozen names, by the profile's own size
    p = fields.sparkSession.createDataFrame(names, "o int, canonical string, rank int, synonym string")
    # a field's rank is that of the first name that fits; labels are few, so each is matched once
    told = fields.select("key").distinct().join(F.broadcast(p), label_matches(F.col("key"), F.col("synonym"))).groupBy("key", "o", "canonical").agg(F.min("rank").alias("rank"))
    hits = fields.select("doc_id", "idx", "key").join(told.hint("shuffle_hash"), "key")

    def work(rows: list[tuple]) -> list[tuple]:
        out, used, done = [], set(), set()
        for doc, o, _, i, canonical in rows:
            if o not in done and i not in used:
                used.add(i)
                done.add(o)
                out.append((doc, i, canonical))
        return out

    chosen = in_groups(hits.select("doc_id", "o", "rank", "idx", "canonical"), 1, "doc_id long, idx long, canonical string", work)
    named = fields.join(chosen.hint("merge"), ["doc_id", "idx"], "left")
    own = named.filter("canonical IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("canonical").alias("_c"), F.col("raw").alias("_r"))
    again = F.col("canonical").isNull() & (F.col("doc_id") == F.col("_d")) & label_matches(F.col("key"), F.col("_c")) & (X.ascii_lower(F.col("raw")) == X.ascii_lower(F.col("_r")))
    return named.join(own.hint("merge"), again, "left_anti")


def field_scores(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, matched, predicted and expected fields: a reference field is matched if a predicted one of its key
    has its value or one contains the other; an empty value only matches an empty one. Both: doc_id, key, value."""
    form = lambda df, k, v: df.select("doc_id", X.ascii_lower(strip(F.col("key"))).alias(k), X.ascii_lower(X.collapse_space(F.col("value"))).alias(v))
    g = form(reference, "gk", "gv").withColumn("_g", F.monotonically_increasing_id())
    p = form(predicted, "pk", "pv")
    same = F.when(F.col("gv") == "", F.col("pv") == "").otherwise((F.col("pv") == F.col("gv")) | F.col("pv").contains(F.col("gv")) | F.col("gv").contains(F.col("pv")))
    on = (g.doc_id == p.doc_id) & (F.col("gk") == F.col("pk")) & same
    hit = g.join(p, on, "left_semi").groupBy("doc_id").agg(F.count("*").alias("matched"))
    n = reference.groupBy("doc_id").agg(F.count("*").alias("expected"))
    m = predicted.groupBy("doc_id").agg(F.count("*").alias("predicted"))
    out = n.join(m, "doc_id", "full_outer").join(hit, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "predicted", "expected")))


def type_accuracy(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of a document's reference blocks whose block of the same number has the same type; both: doc_id, idx, kind."""
    p = predicted.select("doc_id", "idx", F.col("kind").alias("_k"))
    j = reference.join(p, ["doc_id", "idx"], "left")
    return j.groupBy("doc_id").agg(F.avg(F.coalesce((X.ascii_lower(F.col("kind")) == X.ascii_lower(F.col("_k"))).cast("double"), F.lit(0.0))).alias("accuracy"))


# Labels whose value is one word, an amount, or nothing; what ends a value.
ONE_WORD = ("account", "ref", "date", "due", "due date", "seat", "gate", "flight", "class", "booking", "email", "phone", "status", "priority")
ONE_AMOUNT = ("total", "total due", "amount", "amount due", "balance", "closing balance")
NO_VALUE = ("payment terms",)
VALUE_ENDS = (" corpus document", " page ")


def _escaped(label: str) -> str:
    return re.sub(r"([^a-z0-9 ])", r"\\\1", label)


_LABEL_AND_COLON = "(?i)(?<![a-zA-Z0-9])(" + "|".join(_escaped(x) for x in sorted(LABELS, key=lambda x: (-len(x), x))) + "):"


def trimmed_value(text: Column) -> Column:
    """A value up to what ends it, without dashes, bars and semicolons around."""
    cut = F.regexp_replace(strip(text), f"(?is)(?:{'|'.join(VALUE_ENDS)}).*$", "")
    return F.regexp_replace(cut, "^(?U:[-|;\\s])+|(?U:[-|;\\s])+$", "")


def value_of(label: Column, text: Column) -> Column:
    """What of a text behind a label is its value: one word, an amount with the code before it, a period's three words, a
    reference by its mark, or all of it."""
    k = X.ascii_lower(label)

    def told(v: Column) -> Column:
        words = F.filter(F.split(v, "(?U)\\s+"), lambda w: w != "")
        first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
        two = F.when((F.size(words) >= 2) & first.rlike("^[A-Z]{3}$"), F.array_join(F.slice(words, F.lit(1), F.lit(2)), " ")).otherwise(first)
        period = F.when((F.size(words) >= 3) & (F.lower(F.get(words, F.lit(1))) == "to"), F.array_join(F.slice(words, F.lit(1), F.lit(3)), " ")).otherwise(first)
        return (
            F.when(k.isin(*NO_VALUE), "").when(k == "period", period).when(k.isin(*ONE_WORD), first).when((k == "reference") & F.upper(first).startswith("REF-"), first).when(k.isin(*ONE_AMOUNT), two).otherwise(v)
        )

    return V.let(trimmed_value(text), told)


def inline_pairs(text: Column) -> Column:
    """array of struct(label, value) of 'Label: value' inside of one text: each known label with a colon has what stands before
    the next one; without any, a label before the first colon has the rest. Pairs without a value are left out."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(_LABEL_AND_COLON), F.lit(1)), X.ascii_lower)
    known = F.zip_with(labels, F.slice(F.split(text, _LABEL_AND_COLON, -1), F.lit(2), F.greatest(F.size(labels), F.lit(0))), lambda a, b: F.struct(a.alias("label"), value_of(a, b).alias("value")))
    before, behind = strip(F.regexp_extract(text, "(?s)^([^:]*):", 1)), F.regexp_extract(text, "(?s)^[^:]*:(.*)$", 1)
    single = F.when(text.contains(":") & is_label(before), F.array(F.struct(strip_label(before).alias("label"), value_of(strip_label(before), behind).alias("value"))))
    none = F.array().cast("array<struct<label:string,value:string>>")
    return F.filter(F.when(F.size(labels) > 0, known).otherwise(F.coalesce(single, none)), lambda p: p["value"] != "")


def row_pair(row: Column) -> Column:
    """struct(label, value) of a table row whose only two filled cells are a label and something else, or null."""
    filled = F.filter(F.transform(row, strip), lambda c: c != "")
    return V.let(filled, lambda c: F.when((F.size(c) == 2) & is_label(c[0]) & ~is_label(F.get(c, F.lit(1))), F.struct(strip_label(c[0]).alias("label"), F.get(c, F.lit(1)).alias("value"))))


def below_pairs(row: Column, below: Column) -> Column:
    """array of struct(label, value) of a row of two to four labels and nothing else, and the row below it, where that has a
    value under each."""

    def told(cells: Column) -> Column:
        under = lambda c: strip(F.coalesce(F.get(below, c["at"]), F.lit("")))
        good = F.size(cells).between(2, 4) & F.forall(cells, lambda c: is_label(c["text"]) & (under(c) != "") & ~is_label(under(c)))
        pairs = F.transform(cells, lambda c: F.struct(strip_label(c["text"]).alias("label"), trimmed_value(under(c)).alias("value")))
        return F.when(good, pairs).otherwise(F.array().cast("array<struct<label:string,value:string>>"))

    cells = F.filter(F.transform(row, lambda t, i: F.struct(i.alias("at"), t.alias("text"))), lambda c: strip(c["text"]) != "")
    return V.let(cells, told)
