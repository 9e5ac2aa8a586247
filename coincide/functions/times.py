"""FN07-FN17: timestamps of many shapes to UTC instants.

A parsed stamp is a struct of ``wall_us`` (the reading as written, in microseconds as if it were
UTC) and ``offset_s`` (the UTC offset as written, NULL if none was). ``finalize`` turns it into an
instant. The session time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coincide.functions.let import let

# Accepted shapes.
ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?"
ISO_FRACTION = r"^[.,](\d{1,9})"
ISO_OFFSET = r"^(?:[.,]\d{1,9})?(Z|[+-]\d{2}:?\d{2})"
RFC3164 = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
COMPACT = (
    r"(20\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\d|3[01])"
    r"[-_T]?([01]\d|2[0-3])[-_:]?([0-5]\d)[-_:]?([0-5]\d)(?:[.,]?(\d{1,3}))?"
)
EPOCH = r"^\d{9,13}(\.\d+)?$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
SLASHED_12H = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\s+([AaPp])[Mm]$"
SLASHED_YEAR = r"^(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
OFFSET = r"^([+-])(\d{2}):?(\d{2})$"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
CLIP_EPOCH = r"^(1[0-9]{9})(?:\d{3})?$"
CLIP_NAMES = (
    ("UniFi Protect", r"(20\d{2})-(\d{2})-(\d{2})_(\d{2})\.(\d{2})\.(\d{2})"),
    ("ISO 8601", r"(20\d{2})-(\d{2})-(\d{2})[T_](\d{2})[-:](\d{2})[-:](\d{2})"),
    (
        "Dahua / Amcrest",
        r"(?i)(?:ch\d+[_-])?(?:main|sub)?[_-]?(20\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})",
    ),
    ("Hikvision export", r"_(20\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})\d{0,3}"),
    ("Tapo / Reolink / Blue Iris", r"(20\d{2})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})"),
)

_SEP = "\x01"


def groups(text: Column, pattern: str, numbers: list[int], anywhere: bool = False) -> Column:
    """The wanted groups of a match, in one regex pass; read them with :func:`group`.

    ``pattern`` is matched from the start unless ``anywhere``.
    """
    body = pattern.removeprefix("^").removesuffix("$")
    flags = ""
    if body.startswith("(?i)"):
        body, flags = body[4:], "i"
    head = ".*?" if anywhere else ""
    tail = "$" if pattern.endswith("$") else ".*$"
    whole = f"(?s{flags})^{head}(?:{body}){tail}"
    marked = _SEP + _SEP.join(f"${n}" for n in numbers)
    return F.split(F.regexp_replace(F.translate(text, _SEP, ""), whole, marked), _SEP)


def group(parts: Column, n: int) -> Column:
    """The n-th wanted group, from one on; NULL without a match."""
    return F.get(parts, F.lit(n))


def _int(part: Column) -> Column:
    return F.nullif(part, F.lit("")).cast("int")


def _micro(fraction: Column) -> Column:
    """Decimal fraction of a second, as digits, in microseconds."""
    nine = F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 9), 9, "0").cast("bigint")
    return F.call_function("div", nine + 500, F.lit(1000))


def wall_us(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Calendar fields to wall-clock microseconds; NULL if there is no such reading."""
    made = F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)"))
    return F.when(s < 60, F.unix_micros(made.cast("timestamp")))


def _stamp(wall: Column, offset_s: Column | None = None) -> Column:
    offset = F.lit(None).cast("int") if offset_s is None else offset_s.cast("int")
    return let(
        wall.cast("bigint"),
        lambda w: F.when(w.isNotNull(), F.struct(w.alias("wall_us"), offset.alias("offset_s"))),
    )


def _fields(parts: Column, start: int = 1) -> list[Column]:
    return [_int(group(parts, i)) for i in range(start, start + 6)]


def parse_offset(text: Column) -> Column:
    """FN15: ``-04:00``, ``+0530`` or ``Z`` in seconds."""

    def seconds(p: Column) -> Column:
        size = _int(group(p, 2)) * 3600 + _int(group(p, 3)) * 60
        return F.when(group(p, 1) == "-", -size).otherwise(size)

    trimmed = F.trim(text)
    return F.when(F.lower(trimmed).isin("z", "utc"), 0).otherwise(
        let(groups(trimmed, OFFSET, [1, 2, 3]), seconds)
    )


def offset_str(offset_s: Column) -> Column:
    """FN15: seconds as ``-04:00``."""

    def text(offset: Column) -> Column:
        size = F.abs(offset)
        hours = F.call_function("div", size, F.lit(3600)).cast("string")
        minutes = F.call_function("div", size % 3600, F.lit(60)).cast("string")
        sign = F.when(offset < 0, "-").otherwise("+")
        return F.concat(sign, F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(minutes, 2, "0"))

    return let(offset_s, text)


def parse_isoish(text: Column) -> Column:
    """FN07: an ISO-like prefix.

    Once the shape is right, date and time have fixed places and Spark's own cast reads them.
    """

    def offset(tail: Column) -> Column:
        """Seconds of ``Z``, ``+hh:mm`` or ``+hhmm`` after an optional fraction; NULL if absent."""
        return let(
            F.regexp_extract(tail, ISO_OFFSET, 1),
            lambda o: F.when(o == "Z", 0).when(
                o != "",
                F.when(o.startswith("-"), -1).otherwise(1)
                * (_int(o.substr(2, 2)) * 3600 + _int(F.right(o, F.lit(2))) * 60),
            ),
        )

    def read(t: Column) -> Column:
        wall = F.unix_micros(
            F.replace(t.substr(1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").cast("timestamp")
        )
        tail = t.substr(20, 32)
        fraction = F.regexp_extract(tail, ISO_FRACTION, 1)
        return F.when(t.rlike(ISO), _stamp(wall + _micro(fraction), offset(tail)))

    return let(F.trim(text), read)


def parse_rfc3164(text: Column, year: Column) -> Column:
    """FN08: month, day and time; the year comes from elsewhere."""

    def read(p: Column) -> Column:
        at = F.instr(F.lit(MONTHS), group(p, 1))
        month = F.when(
            (at > 0) & (at % 3 == 1), F.call_function("div", at + 2, F.lit(3)).cast("int")
        )
        fields = [year.cast("int"), month, *[_int(group(p, i)) for i in (2, 3, 4, 5)]]
        return _stamp(wall_us(*fields) + _micro(group(p, 6)))

    return let(groups(text, RFC3164, [1, 2, 3, 4, 5, 6]), read)


def parse_compact(text: Column) -> Column:
    """FN09: an embedded run of date and time digits."""
    return let(
        groups(text, COMPACT, [1, 2, 3, 4, 5, 6, 7], anywhere=True),
        lambda p: _stamp(wall_us(*_fields(p)) + _micro(group(p, 7))),
    )


def parse_epoch(text: Column) -> Column:
    """Bare seconds or milliseconds since the epoch."""

    def read(value: Column) -> Column:
        micros = F.when(value > 100_000_000_000, value * 1_000).otherwise(value * 1_000_000)
        return _stamp(F.round(micros).cast("bigint"), F.lit(0))

    return let(F.when(text.rlike(EPOCH), text.try_cast("decimal(30,9)")), read)


def _parse_slashed(text: Column) -> Column:
    def evening(p: Column) -> Column:
        hour = _int(group(p, 4)) % 12 + F.when(F.lower(group(p, 7)) == "p", 12).otherwise(0)
        wall = wall_us(_int(group(p, 3)), _int(group(p, 1)), _int(group(p, 2)), hour, _int(group(p, 5)), _int(group(p, 6)))
        return F.when(_int(group(p, 4)).between(1, 12), wall)

    def slashed(p: Column) -> Column:
        time = [_int(group(p, i)) for i in (4, 5, 6)]
        return F.coalesce(
            wall_us(_int(group(p, 3)), _int(group(p, 1)), _int(group(p, 2)), *time),
            wall_us(_int(group(p, 3)), _int(group(p, 2)), _int(group(p, 1)), *time),
        )

    six = [1, 2, 3, 4, 5, 6]
    return _stamp(
        F.coalesce(
            let(groups(text, SLASHED_12H, [*six, 7]), evening),
            let(groups(text, SLASHED, six), slashed),
            let(groups(text, SLASHED_YEAR, six), lambda p: wall_us(*_fields(p))),
        )
    )


def parse_any(text: Column, year: Column) -> Column:
    """FN10: the first shape that reads."""
    return let(
        F.trim(text.cast("string")),
        lambda t: F.coalesce(
            parse_isoish(t), parse_rfc3164(t, year), parse_epoch(t), parse_compact(t), _parse_slashed(t)
        ),
    )


def _ntz(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _us(ntz: Column) -> Column:
    return F.unix_micros(ntz.cast("timestamp"))


def localize(wall: Column, tz: str, assume_offset_s: Column | None = None) -> Column:
    """FN11: UTC microseconds of a naive reading. In the repeated hour the earlier instant; in
    the skipped hour the offset before the change."""
    if assume_offset_s is not None:
        return wall - assume_offset_s.cast("bigint") * 1_000_000
    return _us(F.convert_timezone(F.lit(tz), F.lit("UTC"), _ntz(wall)))


def to_local(utc_us: Column, tz: str) -> Column:
    """Wall-clock timestamp of an instant in the case's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _ntz(utc_us))


def finalize(stamp: Column, tz: str, assume_offset: str = "", shift_us: int = 0) -> Column:
    """Instant, local reading and observed offset of a parsed stamp.

    FN16: ``shift_us`` is a constant clock correction, applied to both readings.
    """
    assumed = parse_offset(F.lit(assume_offset)) if assume_offset else None

    def instant(s: Column) -> Column:
        written = s["wall_us"] - s["offset_s"].cast("bigint") * 1_000_000
        return F.when(s["offset_s"].isNotNull(), written).otherwise(
            localize(s["wall_us"], tz, assumed)
        )

    def readings(s: Column, utc: Column) -> Column:
        observed = F.call_function("div", s["wall_us"] - utc, F.lit(1_000_000))
        local = to_local(utc, tz)
        if shift_us:
            local = _ntz(_us(local) + F.lit(shift_us))
        moved = utc + F.lit(shift_us)
        return F.struct(
            moved.alias("ts_us"),
            F.timestamp_micros(moved).alias("ts_utc"),
            local.alias("ts_local"),
            offset_str(observed).alias("utc_offset"),
        )

    return let(
        stamp, lambda s: let(instant(s), lambda utc: F.when(utc.isNotNull(), readings(s, utc)))
    )


def dst_edge(wall: Column, tz: str) -> Column:
    """FN12: ``ambiguous`` for a repeated reading, ``nonexistent`` for a skipped one."""

    def edge(utc: Column) -> Column:
        def reads_again(later_us: int) -> Column:
            return _us(to_local(utc + later_us, tz)) == wall

        return F.when(_us(to_local(utc, tz)) != wall, "nonexistent").when(
            reads_again(3_600_000_000) | reads_again(1_800_000_000), "ambiguous"
        )

    return let(localize(wall, tz), edge)


def year_in(utc_us: Column, tz: str) -> Column:
    """FN13: the year of an instant in the case's zone."""
    return F.year(to_local(utc_us, tz))


def rewind_if_future(stamp: Column, reference_us: Column, tz: str) -> Column:
    """FN13: a year-less stamp more than a day after the file's time belongs to the year before."""

    def rewound(s: Column) -> Column:
        wall = s["wall_us"]
        late = localize(wall, tz) > reference_us + F.lit(86_400_000_000)
        earlier = _us(_ntz(wall) - F.expr("INTERVAL '1' YEAR"))
        return _stamp(F.when(late, earlier).otherwise(wall), s["offset_s"])

    return let(stamp, rewound)


def clip_time(name: Column) -> Column:
    """FN14: time and the label of the naming pattern in a clip's file name."""

    def labelled(stamp: Column, label: str) -> Column:
        return let(
            stamp,
            lambda s: F.when(
                s.isNotNull(), F.struct(s.alias("stamp"), F.lit(label).alias("pattern"))
            ),
        )

    def read(label: str, pattern: str) -> Column:
        parts = groups(name, pattern, [1, 2, 3, 4, 5, 6], anywhere=True)
        return labelled(let(parts, lambda p: _stamp(wall_us(*_fields(p)))), label)

    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    epoch = let(
        groups(stem, CLIP_EPOCH, [1]),
        lambda p: _stamp(group(p, 1).cast("bigint") * 1_000_000, F.lit(0)),
    )
    return F.coalesce(
        labelled(epoch, "unix epoch"),
        *[read(label, pattern) for label, pattern in CLIP_NAMES],
        labelled(parse_compact(name), "generic embedded datetime"),
    )
