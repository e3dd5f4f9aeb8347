"""Bank statements and settlement reports: JSON text to canonical rows.

Every field is read as text; a bad row is rejected with a reason and does not
touch the others.  Each row carries the hash of its file and its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import naira_to_kobo
from ..operators.graph import staged
from . import json_files


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, evidence_id): whole files with their SHA-256."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("evidence_id"), F.col("length").alias("byte_length"))


def file_rows(spark: SparkSession, path: str, root: str = "$") -> DataFrame:
    """As ``rows`` of ``files``, with each file read in many tasks: for files of any size, in place of documents in the scans below."""
    found = json_files.array_rows(spark, path, root)
    return found.join(json_files.evidence(spark, path, found), "path").select("evidence_id", F.col("position").cast("int").alias("position"), "lineage", "row")


def paged_rows(spark: SparkSession, path: str, root: str = "$") -> DataFrame:
    """As ``file_rows`` of one statement that comes in pages: files of a folder in order of their paths, each with an array of its own.

    Positions run on from page to page, and all rows have one evidence: of one
    page its own, of several ``pages:`` and the SHA-256 over theirs.  The pages'
    names and counts go to all tasks.
    """
    found = json_files.array_rows(spark, path, root)
    in_order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each page
    counts = found.groupBy("path").agg((F.max("position") + 1).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    own = json_files.evidence(spark, path, found)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("path", "evidence_id"))), lambda x: x["evidence_id"])
    whole = own.agg(ids.alias("ids")).select(F.when(F.size("ids") == 1, F.col("ids")[0]).otherwise(F.concat(F.lit("pages:"), F.sha2(F.array_join("ids", ","), 256))).alias("evidence_id"))
    pages = staged(counts.select("path", "before").crossJoin(whole))
    x = found.join(F.broadcast(pages), "path").withColumn("position", F.col("position") + F.col("before"))
    return x.select("evidence_id", "position", F.concat(F.lit(root + "["), "position", F.lit("]")).alias("lineage"), "row")


def rows(documents: DataFrame, root: str = "$") -> DataFrame:
    """One row per element of a JSON array at ``root`` ($ or $.data): (evidence_id, position, lineage, row); rows of ``file_rows`` as they are."""
    if "row" in documents.columns:
        return documents
    array = F.col("body") if root == "$" else F.get_json_object("body", root)
    element = F.from_json(array, "array<string>")
    x = documents.select("evidence_id", F.posexplode(element).alias("position", "row"))
    return x.withColumn("lineage", F.concat(F.lit(root + "["), "position", F.lit("]")))


def parsed(documents: DataFrame, paths: list[str], root: str = "$", **typed: str) -> DataFrame:
    """Rows with ``r``: the row parsed once, the fields at ``paths`` (``a`` or ``a.b``) as text, those in ``typed`` by their type."""
    outer = {p: "string" for p in paths if "." not in p} | typed
    for top in sorted({p.split(".")[0] for p in paths if "." in p}):
        outer[top] = "struct<" + ", ".join(f"{p.split('.')[1]}: string" for p in paths if p.startswith(f"{top}.")) + ">"
    return rows(documents, root).withColumn("r", F.from_json("row", ", ".join(f"{name} {kind}" for name, kind in outer.items())))


def iso_date(c: Column) -> Column:
    """A bare date or full ISO instant; impossible dates and other shapes are null."""
    bare = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    full = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(bare | full, F.try_to_timestamp(c))


def date_shape(c: Column) -> Column:
    """Digits as 9 and letters as A, for reports of unknown date formats."""
    return F.regexp_replace(F.regexp_replace(c, r"[0-9]", "9"), r"[A-Za-z]", "A")


def scan_bank_statement(documents: DataFrame, bank: str, good_claims: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of statements: canonical columns, ``reject`` (null for good rows) and the columns in ``keep`` (``row``).

    Reasons in order of test: no id, unknown type (the words are credit and
    debit as they stand), no amount, negative amount, no date, an id that came
    before in the file: in any row, or with ``good_claims`` only in rows that
    were good so far.
    """
    x = parsed(documents, ["id", "type", "amount", "balance", "date", "narration", "reference"]).select(
        "evidence_id", "position", "lineage", *keep, "r.id", F.col("r.type").alias("direction"), naira_to_kobo(F.col("r.amount")).alias("amount_kobo"),
        naira_to_kobo(F.col("r.balance")).alias("balance_after_kobo"), F.col("r.date").alias("date_text"), iso_date(F.col("r.date")).alias("value_date"),
        F.coalesce("r.narration", F.lit("")).alias("narration"), F.col("r.reference").alias("stated_reference"),
    )
    reject = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id").when(F.coalesce(~F.col("direction").isin("credit", "debit"), F.lit(True)), F.concat(F.lit("type="), F.coalesce("direction", F.lit(""))))
        .when(F.col("amount_kobo").isNull(), "amount").when(F.col("amount_kobo") < 0, "negative amount").when(F.col("value_date").isNull(), F.concat(F.lit("date="), F.coalesce(date_shape(F.col("date_text")), F.lit(""))))
    )
    x = x.withColumn("reject", reject)
    claims = F.col("reject").isNull() if good_claims else F.lit(True)
    # rows without an id are rejected for that, and need not meet
    alone = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.col("position"))
    before = Window.partitionBy("evidence_id", "id", alone).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("again", F.count(F.when(claims, 1)).over(before) > 1)
    words = F.array_distinct(F.regexp_extract_all(F.upper("narration"), F.lit(r"[A-Z0-9][A-Z0-9_-]{5,}"), F.lit(0)))
    x = x.withColumn("reject", F.coalesce("reject", F.when(F.col("again"), "colliding identity"))).drop("again")
    return x.withColumn("narration_tokens", words).withColumn("idempotency_key", F.concat_ws(":", F.lit("bank"), F.lit(bank), "id"))


#: Wire statuses that end a settlement, in each source's own words.
STATUS = {
    "flutterwave": {"COMPLETED": "settled", "SUCCESSFUL": "settled"},
    "nomba": {"SUCCESS": "settled", "REVERSED": "reversed"},
    "monnify": {"PAID": "settled", "REVERSED": "reversed"},
}
#: Fee types that are taxes.
TAXES = ("stamp_duty", "vat", "emt_levy")
#: Columns of the two reports of plain rows.
LINE_COLUMNS = {
    "nomba": {"root": "$", "reference": "id", "gross": "amountCharged", "fee": "fixedCharge", "net": "amount", "status": "status", "at": "timeCompleted", "currency": "walletCurrency"},
    "monnify": {"root": "$", "reference": "responseBody.transactionReference", "gross": "responseBody.amountPaid", "fee": None, "net": "responseBody.settlementAmount", "status": "responseBody.paymentStatus", "at": "responseBody.paidOn", "currency": "responseBody.currency"},
}


def scan_settlement_lines(documents: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Settlement lines of a report of plain rows; other currencies and open statuses are rejected.  ``keep`` may name status_text, the status as sent."""
    if source not in LINE_COLUMNS:
        raise ValueError(f"no settlement adapter for {source}")
    c = LINE_COLUMNS[source]
    field = lambda name: F.col(f"r.{c[name]}")
    status = F.create_map(*[F.lit(x) for kv in STATUS[source].items() for x in kv])[F.upper(field("status"))]
    x = parsed(documents, [c[name] for name in ("reference", "gross", "net", "status", "at", "currency")], c["root"]).select(
        "evidence_id", "position", "lineage", F.lit(source).alias("source"), field("reference").alias("reference"), naira_to_kobo(field("gross")).alias("gross_kobo"),
        naira_to_kobo(field("net")).alias("net_kobo"), status.alias("status"), field("status").alias("status_text"), iso_date(field("at")).alias("settled_at"), F.upper(field("currency")).alias("currency"),
    )
    x = x.withColumn("fee_kobo", F.col("gross_kobo") - F.col("net_kobo"))
    reject = F.when(F.col("reference").isNull(), "missing reference").when(F.col("currency") != "NGN", "currency").when(F.col("status").isNull(), "not a settlement").when(F.col("gross_kobo").isNull() | F.col("net_kobo").isNull(), "amount").when(F.col("fee_kobo") < 0, "fee")
    x = x if "status_text" in keep else x.drop("status_text")
    return x.withColumn("reject", reject).withColumn("idempotency_key", F.concat_ws(":", F.lit("settlement"), "source", "reference"))


#: Parts of a payout beside its fees.
PARTS = ("chargeback", "refund", "reserve", "reserve_release")


def fees_of(elements: Column) -> Column:
    """The (type, amount) of each fee, an array of JSON texts; null for those that are no objects."""
    return F.transform(elements, lambda f: F.when(f.startswith("{"), F.from_json(f, "type string, amount string")))


def scan_payouts(documents: DataFrame, source: str = "flutterwave", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(payouts, adjustments) of an enveloped report: fees by type, and chargeback, refund, reserve, reserve_release.  ``keep`` may name row, its text."""
    r = parsed(documents, ["id", "gross_amount", "net_amount", "currency", "status", "due_datetime", *PARTS], "$.data", fees="array<string>")
    x = r.select(
        "evidence_id", "position", "lineage", F.lit(source).alias("source"), F.col("r.id").alias("payout_reference"), naira_to_kobo(F.col("r.gross_amount")).alias("gross_kobo"),
        naira_to_kobo(F.col("r.net_amount")).alias("expected_net_kobo"), F.upper("r.currency").alias("currency"), F.upper("r.status").alias("status"), iso_date(F.col("r.due_datetime")).alias("value_date"), "row", "r",
    )
    open_ = ~F.coalesce(F.col("status").isin(*STATUS[source]), F.lit(False))
    reject = F.when(F.col("payout_reference").isNull(), "missing id").when(F.col("currency") != "NGN", "currency").when(open_, "not a settlement").when(F.col("gross_kobo").isNull() | F.col("expected_net_kobo").isNull(), "amount")
    x = x.withColumn("reject", reject)
    kind = lambda t: F.when(F.lower(t).isin(*TAXES), "tax").when(F.lower(t) == "penalty", "penalty").otherwise("fee")
    made = F.concat(
        F.coalesce(F.transform(fees_of(F.col("r.fees")), lambda f: F.struct(kind(f["type"]).alias("kind"), naira_to_kobo(f["amount"]).alias("kobo"))), F.array().cast("array<struct<kind:string,kobo:bigint>>")),
        F.array(*[F.struct(F.lit(k).alias("kind"), (naira_to_kobo(F.col(f"r.{k}")) * (-1 if k == "reserve_release" else 1)).alias("kobo")) for k in PARTS]),
    )
    adjustments = x.where("reject is null").select("payout_reference", F.posexplode(F.filter(made, lambda a: a["kobo"].isNotNull() & (a["kobo"] != 0))).alias("position", "a")).select("payout_reference", "position", "a.kind", "a.kobo")
    return x.drop("r", *({"row"} - set(keep))), adjustments


def drift_profile(documents: DataFrame, known: list[str], root: str = "$") -> DataFrame:
    """Fields outside ``known`` with their count, the first place and the rows of the file."""
    x = rows(documents, root)
    total = x.groupBy("evidence_id").agg(F.count("*").alias("rows_in_file"))
    odd = x.select("evidence_id", "position", "lineage", F.explode(F.array_except(F.json_object_keys("row"), F.array(*[F.lit(k) for k in known]))).alias("detail"))
    found = odd.groupBy("evidence_id", "detail").agg(F.count("*").alias("occurrences"), F.min_by("lineage", "position").alias("first_lineage"))
    return found.join(total, "evidence_id").withColumn("kind", F.lit("unknown_field"))
