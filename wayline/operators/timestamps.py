"""Timestamps in mixed notations, precisions and zones, brought to UTC microseconds."""

from __future__ import annotations

import datetime
import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.times import utc_micros
from wayline.session import cut, lookup_join, made

_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?"
_ZONE = r"\s*(Z|z|[A-Z]{1,6}|[+-]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z0-9_+/-]+)\])?"
#: The cascade, in order. Each pattern is anchored and has a replacement that puts the fields in one order:
#: year|month|day|hour|minute|second|fraction|half of day|zone|region
FORMS: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,18}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: (\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,18}}))?)?(?: ?([AaPp])[Mm])?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("mail", rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
]
NUMBER = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
DAY_US = 86_400_000_000


def abbreviation_offsets(zones: list[str], first: int = 1970, last: int = 2038) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(zone, abbreviation, [(local microseconds from which it counts, offset in seconds)]) as used in each zone by the tz database, in order of time.

    An abbreviation has one entry for every change of its offset; times before the first take the first. Unknown zones give none.
    """
    out: dict[tuple[str, str], list[tuple[int, int]]] = {}
    begin, end = (int(datetime.datetime(y, 1, 1, tzinfo=datetime.UTC).timestamp()) for y in (first, last))
    for name in zones:
        try:
            tz = zoneinfo.ZoneInfo(name)
        except (ValueError, zoneinfo.ZoneInfoNotFoundError, OSError):
            continue

        def at(s: int, tz: zoneinfo.ZoneInfo = tz) -> tuple[str | None, int]:
            t = datetime.datetime.fromtimestamp(s, tz)
            return t.tzname(), int(t.utcoffset().total_seconds())

        s, now = begin, None
        for probe in range(begin, end, 14 * 86_400):
            got = at(probe)
            if got == now:
                s = probe
                continue
            low, high = s, probe
            while now is not None and high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == now else (low, middle)
            abbreviation, offset = got
            if abbreviation and abbreviation.isalpha():
                uses = out.setdefault((name, abbreviation), [])
                if not uses or uses[-1][1] != offset:
                    uses.append(((high + offset) * 1_000_000, offset))
            s, now = probe, got
    return [(z, a, u) for (z, a), u in sorted(out.items())]


def number_us(text: Column) -> Column:
    """Microseconds since 1970 of a bare number whose unit its size tells: s below 1e11, ms below 1e14, us below 1e17, else ns. Finer digits are cut."""
    d = text.try_cast("decimal(38,9)")
    size = F.abs(d)
    us = F.when(size < F.lit(10**11), d * 1_000_000).when(size < F.lit(10**14), d * 1000).when(size < F.lit(10**17), d).otherwise(d / 1000)
    return F.floor(us).cast("long")


def fields(text: Column) -> Column:
    """The pipe-joined fields of a written time (see FORMS) by the first form that matches as a whole; else null."""
    out = F.when(text.rlike(FORMS[0][1]), F.concat(F.lit("iso|"), F.regexp_replace(text, FORMS[0][1], FORMS[0][2])))
    for name, pattern, order in FORMS[1:]:
        out = out.when(text.rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace(text, pattern, order)))
    return out


def _readings(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Adds early and late (us): the instant, and the later one where the local time occurs twice; both null for no instant.

    rows: id, text and more; devices: id, zone_name, date_order. Names starting with __ are dropped again.
    """
    spark = rows.sparkSession
    known = devices.select("id", F.col("zone_name").alias("__zone"), F.col("date_order").alias("__order"))
    # distinct zone names are bounded by the tz database (about 600)
    zones = sorted(r[0] for r in known.select("__zone").distinct().collect() if r[0])
    valid = [z for z in zones if z in zoneinfo.available_timezones()]
    uses = abbreviation_offsets(valid)
    names = F.create_map(*(F.lit(x) for z, a, u in uses for x in (f"{z} {a}", u[0][1]))) if uses else F.create_map().cast("map<string,int>")
    changes = [F.struct(F.lit(f"{z} {a}").alias("name"), F.lit(since).alias("since"), F.lit(o).alias("offset")) for z, a, u in uses for since, o in u[1:]]
    changed = {f"{z} {a}" for z, a, u in uses if len(u) > 1}
    is_zone = F.col("__zone").isin(valid) if valid else F.lit(False)

    part = lambda i: F.get(F.col("__f"), i)
    num = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).try_cast("int")
    x = lookup_join(rows, known, "id")
    x = made(x, __t=F.trim(F.regexp_replace("text", r"[\s\x{A0}]+", " ")))
    x = made(x, __f=F.split(fields(F.col("__t")), r"\|"), __number=F.when(F.col("__t").rlike(NUMBER), number_us(F.col("__t"))))
    swap = (part(0) == "slashes") & (F.col("__order") == "dmy")
    half, h = F.upper(part(8)), num(part(4))
    x = made(
        x,
        __y=num(part(1)),
        __mo=F.when(part(0) == "mail", F.expr(f"cast((instr('{MONTHS}', get(__f, 2)) + 2) div 3 as int)")).otherwise(num(F.when(swap, part(3)).otherwise(part(2)))),
        __d=num(F.when(swap, part(2)).otherwise(part(3))),
        __h=F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "P", 12).otherwise(0)),
        __mi=num(part(5)),
        __s=F.when(num(part(6)) < 60, num(part(6))),
        __us=num(F.substring(F.rpad(part(7), 6, "0"), 1, 6)),
        __ok=(part(0) != "slashes") | F.col("__order").isin("dmy", "mdy"),
        __z=F.upper(part(9)),
        __region=F.nullif(part(10), F.lit("")),
    )
    stamp = F.try_make_timestamp_ntz(*(F.col(c) for c in ("__y", "__mo", "__d", "__h", "__mi", "__s")))
    z, region = F.col("__z"), F.col("__region")
    digits = F.regexp_replace(z, "[^0-9]", "")
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    places = sorted(zoneinfo.available_timezones())
    x = made(
        x,
        __local=F.when(
            F.col("__ok"),
            F.datediff(stamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY_US
            + (F.col("__h").cast("long") * 3600 + F.col("__mi") * 60 + F.col("__s")) * 1_000_000 + F.col("__us"),
        ),
        __here=F.when(z == "", F.when(region.isNull(), F.when(is_zone, F.col("__zone"))).when(region.isin(*places), region)),
        __offset=F.when(z.isin("Z", "UTC", "GMT"), F.lit(0))
        .when(z.rlike(r"^[+-]"), sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + num(F.substring(digits, 3, 2)) * 60))
        .when(z != "", F.element_at(names, F.concat_ws(" ", F.col("__zone"), z))),
        __name=F.concat_ws(" ", F.col("__zone"), z),
    )
    if changed:  # abbreviations that had several offsets: the last that counts from a local time on
        then = F.filter(F.array(*changes), lambda c: (c["name"] == F.col("__name")) & (c["since"] <= F.col("__local")))
        x = made(x, __then=F.when(F.col("__name").isin(*changed), F.get(then, F.size(then) - 1)["offset"]))
        x = x.withColumn("__offset", F.coalesce("__then", "__offset"))
    x = made(x, __early=F.when(F.col("__here").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local"), F.col("__here")))))
    ahead = F.timestamp_micros(F.col("__early") + DAY_US)
    after = F.unix_micros(F.from_utc_timestamp(ahead, F.col("__here"))) - F.unix_micros(ahead)
    x = made(x, __late=F.col("__local") - after, __exact=F.coalesce("__number", F.col("__local") - F.col("__offset").cast("long") * 1_000_000))
    twice = (F.col("__late") > F.col("__early")) & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("__late"), F.col("__here"))) == F.col("__local"))
    x = made(x, early=F.coalesce("__exact", "__early"), late=F.when(F.col("__exact").isNull() & twice, F.col("__late")))
    # the local day on which clocks change, whole: from 18:00 of the day before
    x = made(x, local_day=F.when(is_zone, F.floor((F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("early"), F.col("__zone"))) + DAY_US // 4) / DAY_US)))
    return x.select(*rows.columns, "early", "late", "local_day")


def resolve_in_order(rows: DataFrame) -> DataFrame:
    """Decide the rows of twice-occurring local times by the rule that instants never decrease with seq within an id.

    rows: id, seq, local_day, early, late. Result: id, seq, early, utc_us for the rows with late. A row takes the later reading
    if a row before it (or of equal seq) must be later than its earlier reading, the earlier one if a row after it forces that. Where
    the rule leaves a stretch open, the change lies in the widest silence between its rows (no row counts as endless; ties: the last).
    """
    group = ["id", "local_day"]
    open_days = rows.where("late is not null and seq is not null").select(*group).distinct()
    one = rows.where("early is not null and seq is not null and local_day is not null").join(open_days, group, "left_semi").select(*group, "seq", "early", "late").distinct()
    w = Window.partitionBy(*group).orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy(*group).orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*group)
    sure = F.when(F.col("late").isNull(), F.col("early"))
    unsure = F.when(F.col("late").isNotNull(), F.col("early"))
    sure_that = lambda c: F.coalesce(c, F.lit(False))
    x = (
        one.withColumn("some", F.max("late").over(own)).where("some is not null")
        .withColumn("low", F.max(sure).over(w)).withColumn("high", F.min(sure).over(v))
        .withColumn("low_e", F.max(unsure).over(w)).withColumn("high_e", F.min(unsure).over(v))
        .withColumn("second", F.col("late").isNotNull() & (sure_that(F.col("low") > F.col("early")) | sure_that(F.col("low_e") > F.col("early"))))
        .withColumn("first", F.col("late").isNotNull() & (sure_that(F.col("high") < F.col("late")) | sure_that(F.col("high_e") < F.col("early"))))
        .withColumn("second", F.max("second").over(w)).withColumn("first", F.max("first").over(v) & ~F.col("second"))
    )
    o = Window.partitionBy(*group).orderBy("seq", "early")
    # the silence before a row if it were the first of the second pass: from the row before, read early
    x = (
        x.withColumn("open", F.col("late").isNotNull() & ~F.col("first") & ~F.col("second"))
        .withColumn("prev", F.lag("early").over(o)).withColumn("prev_seq", F.lag("seq").over(o)).withColumn("prev_open", F.coalesce(F.lag("open").over(o), F.lit(False)))
        .withColumn("next_late", F.coalesce("late", "early"))
        .withColumn("gap", F.when(F.col("open") & (F.col("prev_seq").isNull() | (F.col("prev_seq") < F.col("seq"))), F.coalesce(F.col("early") - F.col("prev"), F.lit(2**60)))
                    .when(~F.col("open") & F.col("prev_open"), F.col("next_late") - F.col("prev") - F.lit(3_600_000_000)))
    )
    last_open = F.max(F.when(F.col("open"), F.col("seq"))).over(own)
    x = x.withColumn("end_gap", F.when(F.max("seq").over(own) == last_open, F.lit(2**60)))
    best = F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", "seq"))).over(own)
    x = x.withColumn("turn", F.when(F.col("end_gap").isNotNull(), F.lit(2**62)).otherwise(best["seq"]))
    pick = F.when(F.col("second"), F.col("late")).when(F.col("first"), F.col("early")).when(F.col("seq") >= F.col("turn"), F.col("late")).otherwise(F.col("early"))
    return x.where("late is not null").select("id", "seq", "early", pick.alias("utc_us")).groupBy("id", "seq", "early").agg(F.max("utc_us").alias("utc_us"))


def normalise_sequences(traces: DataFrame, devices: DataFrame) -> DataFrame:
    """UTC instants of sampled sequences: (row_no, id, seq, utc_us), one row per input row; utc_us null where the text names none.

    traces: row_no, id, seq, time (string); devices: id, zone_name, date_order. Ordered cascade of anchored patterns with strict
    fields (FORMS, after trimming): no guess between them, and no date that does not exist. A zone or offset in the text counts; an
    abbreviation means what it means in the device's zone; a text without any is local time of the device (unknown device or zone: no
    instant). A skipped local time takes the offset before the change; one that occurs twice is decided by ``resolve_in_order``
    (rows with null seq: the earlier reading). Null, empty, blank and other texts name no instant; copies of a row get equal instants.
    """
    # parsed and written once; only the rows of days on which clocks change go on
    x = cut(_readings(traces.select("row_no", "id", F.col("seq").cast("long").alias("seq"), F.col("time").cast("string").alias("text")), devices).drop("text"))
    sure = x.where("late is null or seq is null").select("row_no", "id", "seq", F.col("early").alias("utc_us"))
    decided = resolve_in_order(x)
    return sure.unionByName(x.where("late is not null and seq is not null").join(decided, ["id", "seq", "early"]).select("row_no", "id", "seq", "utc_us"))


def normalise_messages(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """UTC instants of raw JSON messages: (row_no, id, utc_us), one row per input row; utc_us null where there is none.

    messages: row_no, received, body. As ``normalise_sequences``, but a local time that occurs twice is the latest reading not after
    ``received`` (the earlier one if both are after it or received is null). Null bodies and bodies that are no JSON object name no instant.
    """
    body = F.from_json("body", "id string, time string")
    got = messages.select("row_no", utc_micros(messages, "received").alias("received"), body.alias("m"))
    x = _readings(got.select("row_no", "received", F.col("m.id").alias("id"), F.col("m.time").alias("text")), devices)
    return x.select("row_no", "id", F.when(F.col("late") <= F.col("received"), F.col("late")).otherwise(F.col("early")).alias("utc_us"))
