"""Card data, redaction, signatures and envelope encryption."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def card_runs(text: Column) -> Column:
    """Digit runs of 13 to 19 digits that pass the Luhn check."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda r: F.length(r).between(13, 19))
    return F.filter(runs, lambda r: F.call_function("luhn_check", r))


def card_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.size(card_runs(F.col(text))).cast("long").alias("n_cards")).where("n_cards > 0")


#: Issuer prefixes with their lengths.
ISSUERS = r"^(4[0-9]{12}([0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|506[01][0-9]{12,15}|650[0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14})$"


#: Prefixes of card schemes and the lengths that each issues.
CARD_SHAPES = (
    ("4", (13, 16, 19)),
    ("5[1-5]", (16,)),
    ("2(?:2[2-9][1-9]|[3-6][0-9]{2}|7[01][0-9]|720)", (16,)),
    ("3[47]", (15,)),
    ("3(?:0[0-5]|[689])", (14,)),
    ("(?:6011|64[4-9]|65)", (16, 19)),
    ("50[6-9]", (16, 18, 19)),
    ("62", (16, 17, 18, 19)),
)
SCHEMES = "^(?:" + "|".join(f"(?={prefix})[0-9]{{{n}}}" for prefix, lengths in CARD_SHAPES for n in lengths) + ")$"
#: Names, in small letters and digits alone, of fields that may never be stored.
SENSITIVE_FIELDS = (
    "cvv", "cvv2", "cvc", "cvc2", "cav2", "csc", "securitycode", "cardsecuritycode", "pin", "pinblock", "encryptedpin",
    "track1", "track2", "trackdata", "track2data", "magneticstripe", "servicecode", "fullpan", "pan", "cardnumber", "cardno",
)
#: Fixed value: 13 to 19 digits with single blanks or hyphens, no digit before or behind.
DIGIT_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"


def looks_like_card(digits: Column, shapes: str = ISSUERS) -> Column:
    """An issuer's prefix and length, and the Luhn check."""
    return digits.rlike(shapes) & F.call_function("luhn_check", digits)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _parse(text: str):
    """JSON as a browser reads it: no NaN, whole floats are integers."""
    whole = lambda x: int(float(x)) if float(x).is_integer() else float(x)
    return json.loads(text, parse_float=whole, parse_constant=lambda x: json.loads("!"))


def _card(value) -> str | None:
    digits = re.sub("[ -]", "", str(value))
    if re.match(SCHEMES, digits, re.ASCII) and _luhn(digits):
        return digits[:6] + "*" * (len(digits) - 10) + digits[-4:]
    return None


def _nodes(x):
    """(steps, value) of a parsed text and all that it holds, in the order of the text; a step is a name or a place, the first one '$'."""
    left = [(("$",), x)]
    while left:
        steps, value = left.pop()
        yield steps, value
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        left += reversed([((*steps, at), item) for at, item in inner])


def _path(steps: tuple, place: str = "[{}]") -> str:
    return "$" + "".join(place.format(s) if isinstance(s, int) else f".{s}" for s in steps[1:])


def _found(steps: tuple, value):
    """A forbidden name, or a value that is a card number as a whole."""
    name = steps[-1]
    if len(steps) > 1 and isinstance(name, str) and re.sub("[^a-z0-9]", "", name.lower()) in SENSITIVE_FIELDS:
        return "sad", _path(steps), name
    number = isinstance(value, (str, int, float)) and not isinstance(value, bool) and _card(value)
    return ("pan", _path(steps), number) if number else None


def _finding(text: str):
    place = "body"
    try:
        parsed, place = _parse(text), "$"
        if found := next(filter(None, (_found(*node) for node in _nodes(parsed))), None):
            return found
    except (ValueError, RecursionError):
        pass
    for run in re.finditer(DIGIT_RUN, text):
        if masked := _card(run[0]):
            return "pan", place, masked
    return None, None, None


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "at", "detail")]))
def _findings(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_finding(t) for t in texts], columns=["kind", "at", "detail"])


def card_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, at, detail): the first card number ('pan') or forbidden field ('sad') of each payload that has one.

    JSON is walked by name and whole value, then all text is read for runs of
    digits; ``at`` is the path, '$' for a run inside JSON, 'body' where the text
    is no JSON.  ``detail`` is the field's name or the masked number.  Built-in
    expressions pass on only texts with 13 digits, a forbidden name or an
    escape; the walk sees no others.  Null texts have no finding.
    """
    shown = F.col(text)
    digits = F.regexp_replace(shown, "[ -]", "").rlike("[0-9]{13}")
    names = F.lower(F.regexp_replace(shown, '[^A-Za-z0-9":]', "")).rlike('"(' + "|".join(SENSITIVE_FIELDS) + ')":')
    found = df.where(digits | names | shown.contains("\\")).select(key, _findings(shown).alias("found"))
    return found.where("found.kind is not null").select(key, "found.*")


def mask(pan: Column) -> Column:
    """First six and last four digits."""
    return F.concat(F.left(pan, F.lit(6)), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(pan) - 10)), F.right(pan, F.lit(4)))


def redact_json(keep: frozenset[str]):
    """Pandas UDF: JSON text with all values replaced whose path (``a.b[].c``) is not kept; other text is replaced whole."""

    def walk(x, path: str):
        if isinstance(x, dict):
            return {k: walk(v, f"{path}.{k}" if path else k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, f"{path}[]") for v in x]
        return x if path in keep or x is None else "[redacted]"

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text), ""), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return "[redacted]"

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return redact


#: The paths of webhook payloads that reconciliation reads; ``[]`` stands for any place in an array.
KEPT_PATHS = frozenset((
    "$.event", "$.data.id", "$.data.status", "$.data.reference", "$.data.amount", "$.data.fees", "$.data.currency", "$.data.channel",
    "$.data.paid_at", "$.data.created_at", "$.data.updated_at", "$.data.message", "$.data.transaction_reference", "$.data.transaction_date", "$.data.refund_created_at",
    "$.type", "$.webhook_id", "$.timestamp", "$.data.created_datetime", "$.data.transaction_datetime",
    "$.data.payment_method.type", "$.data.payment_method_details.type", "$.data.fees[].amount", "$.data.fees[].type",
    "$.eventType", "$.eventData.transactionReference", "$.eventData.paymentReference", "$.eventData.paymentStatus", "$.eventData.status",
    "$.eventData.amountPaid", "$.eventData.amount", "$.eventData.fee", "$.eventData.settlementAmount", "$.eventData.settlementReference", "$.eventData.settlementTime",
    "$.eventData.currency", "$.eventData.paymentMethod", "$.eventData.paidOn", "$.eventData.createdOn", "$.eventData.completedOn", "$.eventData.created_on",
    "$.eventData.paymentSourceInformation.amountPaid",
    "$.event_type", "$.requestId", "$.data.transaction.transactionId", "$.data.transaction.transactionAmount", "$.data.transaction.fee", "$.data.transaction.fixedCharge",
    "$.data.transaction.type", "$.data.transaction.time", "$.data.transaction.entryType", "$.data.transaction.responseCode",
    "$.data.transaction.aliasAccountReference", "$.data.transaction.narration",
))
REDACTION = "keep-list-1"


def _rebuilt(leaves: list):
    """The smallest value that holds the leaves in their order; null of none."""
    tree: dict = {}
    for steps, value in leaves:
        node = tree
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = value
    shaped = lambda x: x if not isinstance(x, dict) else [shaped(v) for v in x.values()] if isinstance(next(iter(x)), int) else {k: shaped(v) for k, v in x.items()}
    return shaped(tree)["$"] if tree else None


def redact_payload(keep: frozenset[str] = KEPT_PATHS, version: str = REDACTION):
    """Pandas UDF: struct (body, dropped) of JSON text without the values whose path is not in ``keep``.

    Objects and arrays left empty go too; dropped nulls are not counted.  The
    body carries a marker with version and count.  Text that is no JSON is
    replaced whole; a null stays null.
    """
    def one(text: str | None):
        if text is None:
            return None, None
        try:
            leaves = [(steps, value) for steps, value in _nodes(_parse(text)) if not isinstance(value, (dict, list))]
        except (ValueError, RecursionError):
            body, dropped = {"redacted": version, "dropped": 0, "reason": "no JSON: replaced whole"}, 0
        else:
            kept = [leaf for leaf in leaves if _path(leaf[0], "[]") in keep]
            dropped = sum(value is not None for _, value in leaves) - sum(value is not None for _, value in kept)
            marker, left = {"redacted": version, "dropped": dropped}, _rebuilt(kept)
            body = left | {"_redaction": marker} if isinstance(left, dict) else {"_redaction": marker, "kept": left}
        return json.dumps(body, ensure_ascii=False, separators=(",", ":")), dropped

    @F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("dropped", T.LongType())]))
    def redact(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["body", "dropped"]).astype({"dropped": "Int64"})

    return redact


def keyed_hash(body: Column, key: bytes, bits: int = 512) -> Column:
    """HMAC of SHA-256 or SHA-512 in hexadecimal by built-in hashes; the key's two blocks are constants."""
    block = 64 if bits == 256 else 128
    key = (hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key).ljust(block, b"\0")
    inner, outer = (F.lit(bytes(k ^ mask for k in key)) for mask in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), bits))), bits)


def verify_webhook(secrets: dict[str, tuple[str, ...]], algorithm: str = "sha512", encoding: str = "hex"):
    """A function of (source, body, signature): whether any of the source's secrets signed the raw body, in hexadecimal or base64."""
    bits = int(algorithm[3:])

    def verify(source: Column | str, body: Column | str, signature: Column | str) -> Column:
        source, body, signature = (F.col(c) if isinstance(c, str) else c for c in (source, body, signature))
        good = F.lit(False)
        for name, keys in secrets.items():
            for key in keys:
                made = keyed_hash(body.cast("binary"), key.encode(), bits)
                good = good | ((source == name) & ((F.base64(F.unhex(made)) if encoding == "base64" else made) == signature))
        return F.coalesce(good, F.lit(False))

    return verify


#: The fields of one provider's signed text, in order; the instant of sending, from a header, follows them.
SIGNED_FIELDS = (
    "event_type", "requestId", "data.merchant.userId", "data.merchant.walletId",
    "data.transaction.transactionId", "data.transaction.type", "data.transaction.time", "data.transaction.responseCode",
)


def canonical_string(body: Column, sent: Column, fields: tuple[str, ...] = SIGNED_FIELDS) -> Column:
    """The text that ``verify_webhook`` gets in place of a raw body where a provider signs fields: joined by colons, a missing one empty, ``sent`` last.

    Null without ``sent`` or where the body is no JSON object.  The amount is
    no part of it, so the signature says nothing about the amount.
    """
    part = lambda f: F.coalesce(F.get_json_object(body, f"$.{f}"), F.lit(""))
    text = F.concat(*[x for f in fields for x in (part(f), F.lit(":"))], sent)
    return F.when(F.json_object_keys(body).isNotNull(), text)


def seal(plain: Column, key: Column, aad: Column) -> Column:
    """AES-GCM with the row's identity as additional data."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


@dataclass(frozen=True)
class KeyRing:
    """Root keys of 32 bytes by id, and the id of the one that wraps new data keys.

    The keys are literals of the plans that use them: guard plans and event logs.
    """

    keys: dict[str, bytes]
    active: str

    def __post_init__(self):
        if self.active not in self.keys:
            raise ValueError(f"the active key {self.active!r} is not in the ring")
        if wrong := [k for k, v in self.keys.items() if len(v) != 32]:
            raise ValueError(f"keys without 32 bytes: {wrong}")

    def root(self, key_id: Column) -> Column:
        return F.create_map(*[F.lit(x) for k, v in self.keys.items() for x in (k, bytearray(v))])[key_id]


@F.pandas_udf(T.BinaryType())
def _fresh_keys(rows: pd.Series) -> pd.Series:
    return pd.Series([secrets.token_bytes(32) for _ in rows])


def context(**parts: Column) -> Column:
    """Additional data from named parts, in the order of their names."""
    return F.concat_ws(chr(31), *[F.concat(F.lit(f"{k}="), parts[k].cast("string")) for k in sorted(parts)]).cast("binary")


def seal_rows(df: DataFrame, ring: KeyRing, plain: Column, aad: Column) -> DataFrame:
    """Adds sealed, wrapped_key and key_id: each row under a data key of its own, which the active root key wraps."""
    fresh = _fresh_keys.asNondeterministic()
    keyed = df.select("*", plain.cast("binary").alias("_plain"), aad.alias("_aad")).select("*", fresh(F.hash("_plain")).alias("_data_key"))
    root = F.lit(bytearray(ring.keys[ring.active]))
    made = keyed.select("*", seal(F.col("_plain"), F.col("_data_key"), F.col("_aad")).alias("sealed"), seal(F.col("_data_key"), root, F.col("_aad")).alias("wrapped_key"), F.lit(ring.active).alias("key_id"))
    return made.drop("_plain", "_aad", "_data_key")


def _opened(sealed: Column, key: Column, aad: Column) -> Column:
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def unseal_rows(df: DataFrame, ring: KeyRing, aad: Column) -> DataFrame:
    """Adds ``plain``; null where bytes or context were altered or the ring lacks the key."""
    return df.withColumn("plain", _opened(F.col("sealed"), _opened(F.col("wrapped_key"), ring.root(F.col("key_id")), aad), aad))


def rotate_rows(df: DataFrame, ring: KeyRing, aad: Column) -> DataFrame:
    """Wraps the data keys anew under the active root key; payloads stay, and so do rows that the ring cannot open."""
    opened = df.withColumn("_data_key", F.when(F.col("key_id") != ring.active, _opened(F.col("wrapped_key"), ring.root(F.col("key_id")), aad)))
    again = seal(F.col("_data_key"), F.lit(bytearray(ring.keys[ring.active])), aad)
    hit = F.col("_data_key").isNotNull()
    out = opened.withColumn("wrapped_key", F.when(hit, again).otherwise(F.col("wrapped_key"))).withColumn("key_id", F.when(hit, F.lit(ring.active)).otherwise(F.col("key_id")))
    return out.drop("_data_key")


def render(value: Column) -> Column:
    """A value for a report: text as it is, at most 64 characters and then an ellipsis; null is 'null'."""
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(F.length(text) > 64, F.concat(F.left(text, F.lit(64)), F.lit("\u2026"))).otherwise(text)
