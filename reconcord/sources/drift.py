"""What moved in a file's format: shapes, fields, values, identities and rows, counted by kind.

Each scan gives rows (evidence_id, kind, detail, occurrences, first_lineage,
sample, rows_in_file, anomaly_key).  One row stands for all of its kind and
detail in one file; place and sample are those of its first row.  The count of
the file's rows includes those that were refused and is 0 where there is no
array.  Null files, empty arrays and empty tables have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import naira_to_kobo
from ..functions.protect import render
from . import statements

#: The fields that each parser reads, by the object that holds them ('' is the row).
FIELDS = {
    "bank": {"": ("id", "date", "amount", "type", "narration", "balance", "reference")},
    "flutterwave": {"": (
        "id", "net_amount", "gross_amount", "currency", "meta", "status", "due_datetime", "transaction_datetime", "created_datetime",
        "fees", "destination", "charge_count", "chargeback", "refund", "reserve", "reserve_release",
    )},
    "nomba": {"": (
        "id", "status", "amount", "fixedCharge", "amountCharged", "type", "entryType", "timeCreated", "timeUpdated", "timeCompleted",
        "walletCurrency", "currency", "merchantTxRef", "rrn", "sessionId",
    )},
    "monnify": {
        "": ("requestSuccessful", "responseMessage", "responseCode", "responseBody"),
        "responseBody": ("transactionReference", "amountPaid", "settlementAmount", "paymentStatus", "paymentMethod", "currency", "paidOn"),
    },
}
#: Wire statuses of money that has not moved.
OPEN = ("PENDING", "FAILED")
#: Known types of fees.
FEES = ("charge_fee", "merchant_fee", "stamp_duty", "vat", "emt_levy", "penalty")


def json_type(text: Column) -> Column:
    """array, object, string, number or boolean; null counts as object, text that is no JSON is null."""
    bare = F.trim(text)
    return (
        F.when(F.from_json(bare, "array<string>").isNotNull() & bare.startswith("["), "array")
        .when((bare.startswith("{") & F.json_object_keys(bare).isNotNull()) | (bare == "null"), "object")
        .when(bare.startswith('"') & F.get_json_object(bare, "$").isNotNull(), "string")
        .when(bare.isin("true", "false"), "boolean")
        .when(bare.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number")
    )


def _shapes(documents: DataFrame, root: str) -> DataFrame:
    """Files that are no array of rows, or whose envelope holds none."""
    own = documents.where("body is not null").select("evidence_id", "body", json_type(F.col("body")).alias("what"))
    if root == "$":
        odd = own.where("what is null or what <> 'array'")
        detail, sample = F.concat(F.lit("expected a bare array, got "), "what"), F.lit(None).cast("string")
    else:
        odd = own.where(F.coalesce(json_type(F.get_json_object("body", root)) != "array", F.lit(True)))
        keys = F.concat(F.lit("top-level keys: "), F.array_join(F.json_object_keys("body"), ", "))
        detail, sample = F.lit(f"no {root} array"), F.when(F.col("what").isNotNull(), F.coalesce(keys, F.when(F.col("what") == "array", "object").otherwise(F.col("what"))))
    detail = F.when(F.col("what").isNull(), "payload is not JSON").otherwise(detail)
    return odd.select("evidence_id", F.lit(-1).alias("position"), F.lit("unknown_shape").alias("kind"), detail.alias("detail"), sample.alias("sample"), F.lit(None).cast("string").alias("lineage"))


def _seen(rows: DataFrame, kind: Column | str, detail: Column, sample: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    sample = F.lit(None).cast("string") if sample is None else sample
    return rows.select("evidence_id", "position", kind.alias("kind"), detail.alias("detail"), sample.alias("sample"), "lineage")


def _after(prefix: str):
    return lambda name: F.concat(F.lit(prefix), name)


def _fields(rows: DataFrame, known: dict[str, tuple[str, ...]], root: str) -> DataFrame:
    """A row for each field outside the known ones, by its path."""
    paths = []
    for at, names in known.items():
        keys = F.json_object_keys(F.col("row") if not at else F.get_json_object("row", f"$.{at}"))
        unread = F.array_except(keys, F.array(*[F.lit(n) for n in names]))
        prefix = f"{root}[]." + (f"{at}." if at else "")
        paths.append(F.coalesce(F.transform(unread, _after(prefix)), F.array().cast("array<string>")))
    return _seen(rows.withColumn("path", F.explode(F.concat(*paths))), "unknown_field", F.col("path"))


def _report(documents: DataFrame, rows: DataFrame, root: str, source: str, *seen: DataFrame) -> DataFrame:
    found = None if "row" in documents.columns else _shapes(documents, root)
    for part in seen:
        found = part if found is None else found.unionByName(part)
    first = F.min(F.struct("position", "lineage", "sample"))
    per = found.groupBy("evidence_id", "kind", "detail").agg(F.count("*").alias("occurrences"), first.alias("first"))
    total = rows.groupBy("evidence_id").agg(F.count("*").alias("rows_in_file"))
    both = per.join(total, "evidence_id", "left").fillna(0, ["rows_in_file"])
    key = F.concat_ws(chr(31), F.lit(source), "kind", "detail")
    return both.select("evidence_id", "kind", "detail", "occurrences", F.col("first.lineage").alias("first_lineage"), F.col("first.sample").alias("sample"), "rows_in_file", key.alias("anomaly_key"))


def _absent(name: str) -> Column:
    """How a field without text is shown: null where the row names it, else undefined."""
    return F.when(F.array_contains(F.json_object_keys("row"), name), "null").otherwise("undefined")


def statement_drift(documents: DataFrame, bank: str) -> DataFrame:
    """Drift of bank statements.

    An unknown type or date is a value (dates by their shape), a repeated id of
    good rows an identity, every other refused row is malformed: one entry a
    file, whatever its reasons.
    """
    rows = statements.rows(documents)
    lines = statements.scan_bank_statement(documents, bank, good_claims=True, keep=("row",)).where("reject is not null")
    word = F.substring_index("reject", "=", 1)
    shown = lambda name, text, as_: F.when(F.col(text).isNull(), _absent(name)).otherwise(render(as_))
    value = F.when(word == "type", shown("type", "direction", F.col("direction"))).when(word == "date", shown("date", "date_text", statements.date_shape(F.col("date_text"))))
    kind = F.when(value.isNotNull(), "unknown_value").when(F.col("reject") == "colliding identity", "colliding_identity").otherwise("malformed_rows")
    refused = lines.withColumn("value", value).withColumn("kind", kind)
    detail = F.when(F.col("value").isNotNull(), F.concat(word, F.lit("="), "value")).otherwise("bank-statement")
    sample = F.coalesce("value", F.when(F.col("kind") == "colliding_identity", F.left("idempotency_key", F.lit(200))).otherwise(F.col("reject")))
    return _report(documents, rows, "$", f"bank:{bank}", _fields(rows, FIELDS["bank"], "$"), _seen(refused, F.col("kind"), detail, sample))


def line_drift(documents: DataFrame, source: str) -> DataFrame:
    """Drift of reports of plain rows: fields at both levels, and rows that cannot be read; a status that is neither final nor open makes a row unreadable."""
    root = statements.LINE_COLUMNS[source]["root"]
    rows = statements.rows(documents, root)
    lines = statements.scan_settlement_lines(documents, source, keep=("status_text",))
    status = F.coalesce(F.upper("status_text"), F.lit(""))
    why = (
        F.when(F.col("reference").isNull(), "missing reference").when(F.col("status").isNull() & ~status.isin(*OPEN), F.concat(F.lit("status="), render(status)))
        .when(F.col("gross_kobo").isNull() | F.col("net_kobo").isNull(), "amount").when(F.col("fee_kobo") < 0, "fee")
    )
    bad = lines.withColumn("why", why).where("why is not null")
    return _report(documents, rows, root, source, _fields(rows, FIELDS[source], root), _seen(bad, "malformed_rows", F.lit(f"{source}-rows"), F.col("why")))


def payout_drift(documents: DataFrame, source: str = "flutterwave") -> DataFrame:
    """Drift of enveloped payout reports: fields, unreadable rows, and unknown types of fees that are not zero, as values without a place."""
    rows = statements.rows(documents, "$.data")
    payouts, _ = statements.scan_payouts(documents, source, keep=("row",))
    status = F.coalesce(F.col("status"), F.lit(""))
    why = (
        F.when(F.col("payout_reference").isNull(), "missing id").when(~status.isin(*statements.STATUS[source], *OPEN), F.concat(F.lit("status="), render(status)))
        .when(F.col("gross_kobo").isNull() | F.col("expected_net_kobo").isNull(), "amount")
    )
    read = payouts.withColumn("why", why)
    fees = statements.fees_of(F.from_json(F.get_json_object("row", "$.fees"), "array<string>"))
    odd = read.where("why is null").select("evidence_id", "position", F.explode(fees).alias("fee")).where("fee is not null").select("evidence_id", "position", F.coalesce("fee.type", F.lit("unknown")).alias("label"), naira_to_kobo(F.col("fee.amount")).alias("kobo"))
    odd = odd.where((F.col("kobo") != 0) & ~F.lower("label").isin(*FEES)).withColumn("lineage", F.lit(None).cast("string"))
    label = render(F.col("label"))
    return _report(
        documents, rows, "$.data", source, _fields(rows, FIELDS[source], "$.data"),
        _seen(read.where("why is not null"), "malformed_rows", F.lit(f"{source}-payouts"), F.col("why")), _seen(odd, "unknown_value", F.concat(F.lit("fees[].type="), label), label),
    )
