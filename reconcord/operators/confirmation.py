"""The bank's stage as a whole: what each credit confirms, what each debit takes back, what is still awaited.

Credits are taken in the order of their keys, each against the inflows that no
earlier one took.  Inflows and credits meet in nodes of their *amounts*, so an
amount that many share costs a row each and no pairs:

* A group of one amount that no name and no allowance ties to others, and whose
  every credit may pay its every inflow, is decided by counts and ranks.
* What is left is folded in order, by cells of amounts.  A cell's frame has a
  row for each credit and inflow of the cell and of a strip on both sides of it,
  never one for each pair.  What credits beyond the strip may take is in doubt; a
  credit of the cell whose outcome hangs on a doubt is left open.
* Open credits are folded at last, with what is in doubt for each of them, a
  component of those that may take the same inflow in one frame.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected, staged
from .matching import SLACK_MINUTES, duplicates_here, line_names, not_before
from .sequential import plain

#: Per cent of confidence of each way that an inflow is confirmed.
CONFIDENCE = {"named": 100, "amount": 90, "amount_set": 85, "bank_charge": 85}
_SLACK = SLACK_MINUTES * 60 * 1_000_000
_EARLY = -(2**62)
#: Of the largest allowance: how wide a cell of amounts is, and the strip on each side of it.
CELL, STRIP = 32, 4
#: Credits or debits for which another frame is made.
FRAME = 10_000


def _frames(rows: DataFrame, key: str) -> F.Column:
    """The frame of a key, about one for ``FRAME`` of the (staged) rows; a frame has all rows of its keys."""
    return F.pmod(F.xxhash64(key), F.lit(1 + rows.count() // FRAME))


def _part(v: str, width: int) -> F.Column:
    """The number of the part of ``width`` amounts that ``v`` is in."""
    return F.expr(f"({v} - pmod({v}, {width}L)) div {width}L")


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def paired(credits: DataFrame, inflows: DataFrame) -> DataFrame:
    """(idempotency_key, pair): groups of two and more free credits and as many free inflows of one amount, first in first out.

    Every inflow of a group must come from a source that pairs (``pairs``), and
    its earliest credit must be allowed to pay its latest inflow.
    """
    c = credits.groupBy("amount_kobo").agg(F.count("*").alias("n"), F.min("value_date").alias("credit_date"))
    i = inflows.groupBy(F.col("expected_net_kobo").alias("amount_kobo")).agg(F.count("*").alias("m"), F.max("value_date").alias("inflow_date"), F.min(F.col("pairs").cast("int")).alias("pairs"))
    good = c.join(i, "amount_kobo").where((F.col("n") >= 2) & (F.col("n") == F.col("m")) & (F.col("pairs") == 1) & not_before("credit_date", "inflow_date")).select("amount_kobo")
    order = lambda key: Window.partitionBy("amount_kobo").orderBy(F.coalesce("value_date", F.to_timestamp(F.lit("1970-01-01"))), key)
    left = credits.join(good, "amount_kobo", "left_semi").select("amount_kobo", "idempotency_key", F.row_number().over(order("idempotency_key")).alias("rn"))
    right = inflows.withColumn("amount_kobo", F.col("expected_net_kobo")).join(good, "amount_kobo", "left_semi").select("amount_kobo", F.col("inflow_key").alias("pair"), F.row_number().over(order("inflow_key")).alias("rn"))
    return left.join(right, ["amount_kobo", "rn"]).select("idempotency_key", "pair")


def _tied(credits: DataFrame, inflows: DataFrame, most: int) -> DataFrame:
    """The distinct amounts of credits that an inflow with an allowance is up to ``most`` above, and of such inflows; found by bands, without pairs."""
    if not most:
        return credits.select("amount_kobo").limit(0)
    values = lambda df, c: df.select(F.col(c).alias("amount_kobo")).distinct().withColumn("band", _part("amount_kobo", most + 1))
    a, e = values(credits, "amount_kobo"), values(inflows.where("allowance_kobo > 0"), "expected_net_kobo")
    ends = lambda df: df.groupBy("band").agg(F.min("amount_kobo").alias("least"), F.max("amount_kobo").alias("largest"))
    above, below = ends(e), ends(a)
    has_e = a.join(above.select("band", F.col("largest").alias("here")), "band", "left").join(above.select((F.col("band") - 1).alias("band"), F.col("least").alias("next")), "band", "left")
    has_a = e.join(below.select("band", F.col("least").alias("here")), "band", "left").join(below.select((F.col("band") + 1).alias("band"), F.col("largest").alias("next")), "band", "left")
    return has_e.where(f"here > amount_kobo or next - amount_kobo <= {most}").select("amount_kobo").union(has_a.where(f"here < amount_kobo or amount_kobo - next <= {most}").select("amount_kobo")).distinct()


def _by_counts(credits: DataFrame, inflows: DataFrame) -> DataFrame:
    """Outcomes of isolated groups: a single inflow goes to the first credit; a set pairs, and its last credit finds one left."""
    n = inflows.groupBy(F.col("expected_net_kobo").alias("amount_kobo")).agg(F.count("*").alias("m"), F.min("inflow_key").alias("only"))
    first = credits.groupBy("amount_kobo").agg(F.min("idempotency_key").alias("first"), F.max("idempotency_key").alias("last"))
    x = credits.join(n, "amount_kobo", "left").join(first, "amount_kobo")
    takes = F.when((F.col("m") == 1) & (F.col("idempotency_key") == F.col("first")), F.col("only")).otherwise(F.col("pair"))
    how = F.when((F.col("m") == 1) | (F.col("idempotency_key") == F.col("last")), "amount").otherwise("amount_set")
    return x.select("idempotency_key", takes.alias("inflow_key"), F.when(takes.isNotNull(), how).alias("how"), F.when(takes.isNotNull(), F.lit(0)).cast("long").alias("short_kobo"), F.col("amount_kobo").alias("kobo"))


OUTCOME = "idempotency_key string, inflow_key string, how string, short_kobo long, kobo long"
#: Of open credits there is a row for each inflow that is not taken for sure, with the way in which it may be taken.
_ROW = f"{OUTCOME}, allowance_kobo long"
_NAME, _FIT, _PAIR, _MANY, _NONE = "open name", "open fit", "open pair", "open many", "open"


def _table(keys: pa.Array, inflows: pa.Array, rows: list[tuple]) -> pa.Table:
    """Rows (place of the key, place of the inflow, how, short_kobo, kobo, allowance_kobo)."""
    row, inflow, how, *numbers = zip(*rows, strict=True) if rows else [()] * 6
    columns = [keys.take(pa.array(row, pa.int64())), inflows.take(pa.array(inflow, pa.int64())), pa.array(how, pa.string()), *[pa.array(x, pa.int64()) for x in numbers]]
    return pa.table(columns, [c.split()[0] for c in _ROW.split(", ")])


def _cell(low: int, high: int, core: range, most: int, credits: list[tuple], inflows: list[tuple], out: list[tuple]) -> None:
    """Appends the outcomes (key, inflow, how, short, amount, allowance) of the credits within ``core``, all in the order of their keys.

    Seen are the credits and inflows of amounts from ``low`` to below ``high``.
    credits: (key, amount, at, names, pair), names (key, amount, allowance);
    inflows: (key, amount, allowance, at).
    """
    known: dict[str, tuple[int, int, int]] = {}  # not taken for sure
    sure: dict[int, dict[str, None]] = {}  # not taken; the others of known are in doubt
    doubted: list[tuple[int, str]] = []
    for key, e, allow, at in inflows:
        known[key] = (e, allow, at)
        if e - most >= low:  # who may take it is seen
            sure.setdefault(e, {})[key] = None
        else:
            doubted.append((e, key))
    doubted.sort()
    amounts = sorted(sure)
    n = len(amounts)
    later = list(range(n + 1))  # of each place in amounts, one from which on those without inflows are passed over

    def open_from(k: int) -> int:
        """The first place from ``k`` on whose amount has an inflow left."""
        end = k
        while True:
            while later[end] != end:
                end = later[end]
            if end == n or sure[amounts[end]]:
                break
            later[end] = end + 1
        while k != end:
            k, later[k] = later[k], end
        return end

    def is_sure(key: str) -> bool:
        return key in known and key in sure.get(known[key][0], ())

    def gone(key: str, into_doubt: bool) -> None:
        place = (known[key][0], key)
        if is_sure(key):
            sure[place[0]].pop(key)
            if into_doubt:
                insort(doubted, place)
        elif not into_doubt:
            doubted.pop(bisect_left(doubted, place))
        if not into_doubt:
            known.pop(key)

    for key, amount, at, names, pair in credits:
        pick, how, may, fits, many = None, None, None, [], False
        named = [x for x in names if x[0] in known or not low <= x[1] < high]
        certain = [x[0] for x in named if is_sure(x[0])]
        hangs = len(certain) < 2 and len(certain) < len(named)
        if len(certain) == 1 and not hangs:
            pick, how = certain[0], "named"
        elif certain:
            may = certain if hangs else None
        else:
            k = open_from(bisect_left(amounts, amount))
            while k < n and (e := amounts[k]) <= amount + most and len(fits) < 2:
                for inflow in sure[e]:
                    _, allow, due = known[inflow]
                    if e - amount <= allow and at >= due - _SLACK:
                        fits.append(inflow)
                        if len(fits) > 1:
                            break
                k += 1
                if later[k] != k or (k < n and not sure[amounts[k]]):
                    k = open_from(k)
            many, maybe = len(fits) > 1, []
            if not many:
                for k in range(bisect_left(doubted, (amount,)), len(doubted)):
                    e, inflow = doubted[k]
                    if e > amount + most:
                        break
                    if e - amount <= known[inflow][1] and at >= known[inflow][2] - _SLACK:
                        maybe.append(inflow)
            if many:
                pick, how = (pair, "amount_set") if pair in known else (None, None)
                hangs = hangs or (pick is not None and not is_sure(pair))
            elif maybe or amount + most >= high:
                hangs, may = True, [*(fits or maybe), *([pair] if pair in known else [])]
            elif fits:
                pick, how = fits[0], "amount"
            elif pair in known:
                pick, how = pair, "amount_set"
                hangs = hangs or not is_sure(pair)
            if hangs:
                may = [*(may or []), *([pick] if pick is not None else []), *[x[0] for x in named]]
                fits, pick = [] if many else [*fits, *maybe], None
        short = None
        if may is not None:
            for inflow in may:
                if inflow in known and 0 <= known[inflow][0] - amount <= known[inflow][1]:
                    gone(inflow, True)
            if amount in core:
                out.append((key, None, _MANY if many else _NONE, None, amount, None))
                out += [(key, k, _NAME, e - amount, amount, allow) for k, e, allow in named]
                out += [(key, k, _FIT, known[k][0] - amount, amount, known[k][1]) for k in fits if not certain]
                if pair in known and not certain:
                    out.append((key, pair, _PAIR, 0, amount, known[pair][1]))
            continue
        if pick is not None:
            short = known[pick][0] - amount
            if not 0 <= short <= known[pick][1]:
                how = "mismatch"
            else:
                how = "bank_charge" if short else how
                gone(pick, False)
        if amount in core:
            out.append((key, pick, how, short, amount, None))


def _fold(credits: pa.Table, inflows: pa.Table, most: int, width: int, strip: int) -> pa.Table:
    """Rows of the credits of whole cells; credits and inflows go by places in the frame."""
    credits, inflows = credits.sort_by([("cell", "ascending"), ("idempotency_key", "ascending")]), inflows.sort_by("cell")
    lists, coded = credits["names"].combine_chunks(), inflows["inflow_key"].combine_chunks().dictionary_encode()
    said = lists.flatten()
    all_keys = pa.concat_arrays([coded.dictionary, said.field("inflow_key")])  # named ones that are not here have places behind the others
    known = lambda keys: plain(pc.index_in(keys, value_set=coded.dictionary))
    places = [len(coded.dictionary) + k if x is None else x for k, x in enumerate(known(said.field("inflow_key")))]
    named = list(zip(places, *[plain(said.field(c)) for c in ("expected_net_kobo", "allowance_kobo")], strict=True))
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist() if len(lists) else []
    cells, amounts, at = (plain(credits[c]) for c in ("cell", "amount_kobo", "at"))
    pairs = known(credits["pair"].combine_chunks())
    of = {cell: [r[:4] for r in rows] for cell, rows in groupby(zip(plain(coded.indices), *[plain(inflows[c]) for c in ("expected_net_kobo", "allowance_kobo", "at", "cell")], strict=True), lambda r: r[4])}
    out: list[tuple] = []
    for cell, own in groupby(range(len(cells)), cells.__getitem__):
        core, own = range(cell * width, (cell + 1) * width), list(own)
        if any(amounts[k] in core for k in own):
            rows = [(k, amounts[k], at[k], named[ends[k]:ends[k + 1]], pairs[k]) for k in own]
            _cell(core.start - strip, core.stop + strip, core, most, rows, of.get(cell, []), out)
    return _table(credits["idempotency_key"], all_keys, out)


def _settle(rows: pa.Table) -> pa.Table:
    """Outcomes of open credits in the order of their keys; ``gone`` says that a settled credit before took the inflow."""
    rows = rows.sort_by("idempotency_key")
    taken: set[str] = set()
    out = []
    keys, inflows, ways, gone = (rows[c].to_pylist() for c in ("idempotency_key", "inflow_key", "how", "gone"))
    shorts, amounts, allowed = (plain(rows[c]) for c in ("short_kobo", "kobo", "allowance_kobo"))
    for _, own in groupby(range(len(keys)), keys.__getitem__):
        own = list(own)
        left = [k for k in own if inflows[k] is not None and not gone[k] and inflows[k] not in taken]
        named, fits, pair = ([k for k in left if ways[k] == way] for way in (_NAME, _FIT, _PAIR))
        pick, how = None, None
        if named:
            pick, how = (named[0], "named") if len(named) == 1 else (None, None)
        elif len(fits) == 1:
            pick, how = fits[0], "amount"
        elif pair:
            pick, how = pair[0], "amount_set"
        if pick is None:
            out.append((own[0], None, None, None, amounts[own[0]], None))
        elif not 0 <= shorts[pick] <= allowed[pick]:
            out.append((pick, pick, "mismatch", shorts[pick], amounts[pick], None))
        else:
            taken.add(inflows[pick])
            out.append((pick, pick, "bank_charge" if shorts[pick] else how, shorts[pick], amounts[pick], None))
    return _table(rows["idempotency_key"], rows["inflow_key"], out).drop_columns("allowance_kobo")


def _settled(rows: DataFrame) -> DataFrame:
    """Outcomes of the credits that the cells left open."""
    takers = rows.where("settled and inflow_key is not null and how <> 'mismatch'").select("inflow_key", F.col("idempotency_key").alias("by"))
    left = rows.where("not settled").drop("settled").join(takers, "inflow_key", "left")
    left = staged(left.withColumn("gone", F.coalesce(F.col("by") < F.col("idempotency_key"), F.lit(False))).drop("by"))
    own = F.col("idempotency_key")
    if left.count() > FRAME:
        ends = left.where("inflow_key is not null and not gone").select(F.concat(F.lit("c:"), own).alias("a"), F.concat(F.lit("i:"), "inflow_key").alias("b"))
        comp = connected(ends).where("id like 'c:%'").select(F.expr("substr(id, 3)").alias("idempotency_key"), "component")
        left = left.join(comp, "idempotency_key", "left").withColumn("component", F.coalesce("component", own))
        frame = _frames(left, "component")
    else:
        frame = F.lit(0)
    return left.withColumn("frame", frame).groupBy("frame").applyInArrow(_settle, OUTCOME)


def match_credits(credits: DataFrame, inflows: DataFrame, names: DataFrame) -> DataFrame:
    """(idempotency_key, inflow_key, how, short_kobo, kobo) of each credit; without inflow where none fits, 'mismatch' where the named one does not.

    credits: idempotency_key, amount_kobo, value_date; inflows: inflow_key,
    expected_net_kobo, value_date, allowance_kobo, pairs; names: all pairs of a
    credit and an open inflow that it names.  An inflow without date may be paid
    at any time.
    """
    own = names.join(inflows.select("inflow_key", "expected_net_kobo", "allowance_kobo"), "inflow_key")
    lists = own.groupBy("idempotency_key").agg(F.sort_array(F.collect_list(F.struct("inflow_key", "expected_net_kobo", "allowance_kobo"))).alias("names"))  # what one statement line names
    at = F.coalesce(_micros("value_date"), F.lit(_EARLY)).alias("at")
    named = staged(credits.join(lists, "idempotency_key", "left").select("idempotency_key", "amount_kobo", "value_date", at, "names"))
    said = named.select(F.explode("names.inflow_key").alias("inflow_key")).distinct()
    pair = paired(named.where("names is null"), inflows.join(said, "inflow_key", "left_anti"))
    c = staged(named.drop("value_date").join(pair, "idempotency_key", "left"))
    i = inflows.select("inflow_key", "expected_net_kobo", "allowance_kobo", at)

    most = inflows.agg(F.max("allowance_kobo")).first()[0] or 0
    # amounts that a fold must decide: tied to others or to names, or with a credit that may not pay each of the inflows
    by_name = c.where("names is not null").select(F.explode(F.concat(F.array("amount_kobo"), F.col("names.expected_net_kobo"))).alias("amount_kobo"))
    dates = c.groupBy("amount_kobo").agg(F.min("at").alias("first")).join(i.groupBy(F.col("expected_net_kobo").alias("amount_kobo")).agg(F.max("at").alias("last")), "amount_kobo")
    barred = dates.where(F.col("first") < F.col("last") - _SLACK).select("amount_kobo")
    loose = staged(_tied(c, i, most).union(by_name).union(barred).distinct())
    # a cell has what lies within it and its strips
    width, strip = max(1, CELL * most), STRIP * most
    cells = lambda df, v: df.withColumn("cell", F.explode(F.sequence(_part(f"({v} - {strip})", width), _part(f"({v} + {strip})", width))))
    left, right = cells(c.join(loose, "amount_kobo", "left_semi"), "amount_kobo"), cells(i.join(loose.withColumnRenamed("amount_kobo", "expected_net_kobo"), "expected_net_kobo", "left_semi"), "expected_net_kobo")
    frame = _frames(c, "cell").alias("frame")
    fold = lambda credits, inflows: _fold(credits, inflows, most, width, strip)
    rows = left.select(frame, "cell", "idempotency_key", "amount_kobo", "at", "names", "pair").groupBy("frame").cogroup(right.select(frame, "cell", "inflow_key", "expected_net_kobo", "allowance_kobo", "at").groupBy("frame")).applyInArrow(fold, _ROW)
    rows = staged(rows.withColumn("settled", ~F.coalesce(F.col("how").startswith(_NONE), F.lit(False))))
    folded = rows.where("settled").select("idempotency_key", "inflow_key", "how", "short_kobo", "kobo").unionByName(_settled(rows))
    apart = _by_counts(c.join(loose, "amount_kobo", "left_anti"), i.join(loose.withColumnRenamed("amount_kobo", "expected_net_kobo"), "expected_net_kobo", "left_anti"))
    return folded.unionByName(apart)


def _take_back(debits: pd.DataFrame, banked: pd.DataFrame) -> pd.DataFrame:
    """Debits of some amounts in the order of their keys, some of which name inflows."""
    open_: dict[int, set] = {}
    for key, amount in banked[["inflow_key", "amount_kobo"]].itertuples(index=False, name=None):
        open_.setdefault(amount, set()).add(key)
    out = []
    for key, amount, names in debits.sort_values("idempotency_key")[["idempotency_key", "amount_kobo", "names"]].itertuples(index=False, name=None):
        own = open_.get(amount, set())
        named = [k for k in (names if names is not None else ()) if k in own]
        pick = named[0] if len(named) == 1 else next(iter(own)) if not named and len(own) == 1 else None
        if pick is not None:
            own.discard(pick)
            out.append((key, pick))
    return pd.DataFrame(out, columns=["idempotency_key", "inflow_key"])


def take_back(debits: DataFrame, banked: DataFrame, names: DataFrame) -> DataFrame:
    """(idempotency_key, inflow_key): the banked inflow of exactly its amount that each debit returns, one debit each.

    The only one that the debit names, or without a name the only one there is.
    Amounts that no debit's name touches are decided by counts.
    """
    own = names.join(banked.select("inflow_key"), "inflow_key", "left_semi").groupBy("idempotency_key").agg(F.sort_array(F.collect_list("inflow_key")).alias("names"))
    d = staged(debits.select("idempotency_key", "amount_kobo").join(own, "idempotency_key", "left"))
    b = banked.select("inflow_key", F.col("credited_kobo").alias("amount_kobo"))
    touched = d.where("names is not null").select("amount_kobo").distinct()
    frame = _frames(d, "amount_kobo").alias("frame")
    own, against = (x.join(touched, "amount_kobo", "left_semi").select("*", frame).groupBy("frame") for x in (d, b))
    some = own.cogroup(against).applyInPandas(_take_back, "idempotency_key string, inflow_key string")
    sole = b.groupBy("amount_kobo").agg(F.count("*").alias("n"), F.min("inflow_key").alias("inflow_key")).where("n = 1")
    rest = d.join(touched, "amount_kobo", "left_anti").groupBy("amount_kobo").agg(F.min("idempotency_key").alias("idempotency_key")).join(sole, "amount_kobo").select("idempotency_key", "inflow_key")
    return some.unionByName(rest)


def bank_stage(inflows: DataFrame, lines: DataFrame, banked: DataFrame, as_of: F.Column) -> DataFrame:
    """Every outcome of a run against the bank: (subject, idempotency_key, inflow_key, reason, how, kobo, deferred).

    inflows: inflow_key, expected_net_kobo, value_date, escalates_at (null: never
    overdue), allowance_kobo and pairs of its source; lines: bank lines of both
    directions; banked: inflow_key, credited_kobo of earlier runs.

    BANK_CONFIRMED and BANK_CHARGE (kobo: what is short), AMOUNT_MISMATCH,
    DUPLICATE_BANK_CREDIT and UNIDENTIFIED_CREDIT of credits; RETURNED_PAYOUT of
    debits; MISSING_SETTLEMENT and AWAITING_BANK_CREDIT of inflows.
    """
    credits = staged(lines.where("direction = 'credit' and amount_kobo > 0").select("idempotency_key", "amount_kobo", "value_date", "narration", "stated_reference"))
    inflows, banked = staged(inflows), staged(banked.select("inflow_key", "credited_kobo"))
    known = inflows.select("inflow_key").union(banked.select("inflow_key")).distinct()
    names = staged(line_names(credits, known))
    found = staged(match_credits(credits, inflows, names))
    taken = staged(found.where("inflow_key is not null and how <> 'mismatch'"))
    here = taken.select("inflow_key", F.col("idempotency_key").alias("confirmed_by"), F.col("kobo").alias("credited_kobo"))
    # what was banked in earlier runs comes before every credit of this one
    ever = staged(banked.select("inflow_key", F.lit("").alias("confirmed_by"), "credited_kobo").unionByName(here))

    row = lambda df, subject, reason, key="idempotency_key", inflow="inflow_key", how=None, kobo=None, deferred=False: df.select(
        F.lit(subject).alias("subject"), F.col(key).alias("idempotency_key") if key else F.lit(None).cast("string").alias("idempotency_key"), F.col(inflow).alias("inflow_key") if inflow else F.lit(None).cast("string").alias("inflow_key"),
        reason.alias("reason"), (F.lit(None).cast("string") if how is None else F.col(how)).alias("how"), (F.lit(None).cast("long") if kobo is None else F.col(kobo)).alias("kobo"), F.lit(deferred).alias("deferred"),
    )
    matched = row(taken, "credit", F.when(F.col("how") == "bank_charge", "BANK_CHARGE").otherwise("BANK_CONFIRMED"), how="how", kobo="short_kobo")
    wrong = row(found.where("how = 'mismatch'"), "credit", F.lit("AMOUNT_MISMATCH"), kobo="short_kobo")
    left = staged(found.where("inflow_key is null").select("idempotency_key", F.col("kobo").alias("amount_kobo")))
    twice = staged(duplicates_here(left, names, ever))
    duplicate = row(twice, "credit", F.lit("DUPLICATE_BANK_CREDIT"))
    unknown = row(left.join(twice.select("idempotency_key"), "idempotency_key", "left_anti"), "credit", F.lit("UNIDENTIFIED_CREDIT"), inflow=None)
    debits = lines.where("direction = 'debit'")
    back = row(take_back(debits, ever, line_names(debits, ever.select("inflow_key").distinct())), "debit", F.lit("RETURNED_PAYOUT"))
    open_ = inflows.join(taken.select("inflow_key"), "inflow_key", "left_anti")
    late = F.coalesce(as_of > F.col("escalates_at"), F.lit(False))
    missing = row(open_.where(late), "inflow", F.lit("MISSING_SETTLEMENT"), key=None)
    waits = row(open_.where(~late), "inflow", F.lit("AWAITING_BANK_CREDIT"), key=None, deferred=True)
    out = matched
    for part in (wrong, duplicate, unknown, back, missing, waits):
        out = out.unionByName(part)
    return out
