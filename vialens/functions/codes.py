"""Service codes, vendors, directions, stop names and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vialens.constants import OUT_OF_SERVICE, VENDORS

_ASCII_LOWER, _ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vendor(raw: Column) -> Column:
    """The on-board unit's maker: one of the known names, else ``unknown``."""
    name = F.lower(F.trim(raw))
    return F.when(name.isin(VENDORS), name).otherwise("unknown")


def direction(raw: Column) -> Column:
    """``ida``, ``volta``, ``circular`` or null from the feeds' spellings."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin("i", "ida", "0"), "ida").when(s.isin("v", "volta", "1"), "volta").when(s.isin("c", "circular", "unico", "único"), "circular")


def direction_id(name: Column) -> Column:
    return F.when(name == "ida", 0).when(name == "volta", 1)


def ascii_upper(s: Column) -> Column:
    """Upper case for a-z only: accented letters keep their case."""
    return F.translate(s, _ASCII_LOWER, _ASCII_UPPER)


def service_state(code: Column) -> Column:
    """``unknown`` for blank, ``out`` for codes without passengers, else ``named``."""
    s = F.trim(F.coalesce(code, F.lit("")))
    up = ascii_upper(s)
    parts = F.split(up, "[^A-Z0-9]")
    out = s.rlike("^0+$") | F.exists(parts, lambda w: (w == "GAR") | w.startswith("GARAG")) | up.isin(OUT_OF_SERVICE)
    return F.when(s == "", "unknown").when(out, "out").otherwise("named")


def code_keys(code: Column) -> list[Column]:
    """The spellings under which a code is looked up, in turn: as it is, without leading zeros, padded to three."""
    s = F.trim(code)
    bare = F.ltrim(s, F.lit("0"))
    return [s, bare, F.when(F.length(bare) < 3, F.lpad(bare, 3, "0")).otherwise(bare)]


def is_provisional(code: Column) -> Column:
    return code.startswith("LECD")


def hex_color(raw: Column) -> Column:
    """``#RRGGBB`` in upper case for six hexadecimal digits, else an empty string."""
    return F.when(F.trim(raw).rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(F.trim(raw)))).otherwise("")


def sanitize(name: Column) -> Column:
    """A name that is safe as a path segment."""
    return F.regexp_replace(name, r"[^A-Za-z0-9\-_.]", "_")


def stop_name(raw: Column) -> Column:
    return _stop_parts(raw)[0]


def stop_note(raw: Column) -> Column:
    return _stop_parts(raw)[1]


def _stop_parts(raw: Column) -> tuple[Column, Column]:
    """A stop's plain name, and its lanes, terminal kind and complement joined by a middle dot."""
    whole = F.trim(raw)
    at = F.instr(whole, "::")
    head = F.when(at > 0, F.trim(F.substring(whole, F.lit(1), at - 1))).otherwise(whole)
    complement = F.when(at > 0, F.trim(F.substring(whole, at + 2, F.length(whole)))).otherwise("")
    rest = F.regexp_extract(head, r"^BRS ?(.*)$", 1)
    lanes = F.filter(F.transform(F.split(F.substring_index(rest, ":", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    brs = head.startswith("BRS") & (F.instr(rest, ":") > 0) & (F.size(lanes) > 0)
    after = F.trim(F.substring(rest, F.instr(rest, ":") + 1, F.length(rest)))
    last = (~head.startswith("BRS")) & head.startswith("Ponto Final:")
    first = (~head.startswith("BRS")) & head.startswith("Ponto Regulador:")
    tail = F.trim(F.substring(head, F.instr(head, ":") + 1, F.length(head)))
    name = F.when(brs, after).when(last | first, tail).otherwise(head)
    kind = F.when(brs, F.concat(F.lit("BRS "), F.array_join(lanes, ", "))).when(last, "Ponto final").when(first, "Ponto regulador").otherwise("")
    note = F.array_join(F.filter(F.array(kind, complement), lambda x: x != ""), " · ")
    return F.when(name == "", whole).otherwise(name), note
