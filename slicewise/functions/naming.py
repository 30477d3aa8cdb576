"""Service slice and cell of a module path, run and scenario of a file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what identifies a slice, a cell and a server application
SLICE_TOKENS = [("eMBB", "ueembb", "serverembb"),
                ("URLLC", "ueurllc", "serverurllc"),
                ("mMTC", "uemmtc", "servermmtc")]
CELL_SUFFIXES = [("Macro", "_a["), ("Commerce", "_b["), ("Industrie", "_c[")]
CELL_PATHS = [("Macro", "gnbmacro"), ("Commerce", "gnbcommerce"), ("Industrie", "gnbindustrie")]
PART_PREFIX = "log="
SERVER_APPS = [("Macro", 0), ("Commerce", 1), ("Industrie", 2)]


def _ladder(branches: list[tuple[Column, Column]]) -> Column:
    """First true condition wins, null when none holds."""
    return F.coalesce(*[F.when(cond, value) for cond, value in branches])


def slice_of(module: Column) -> Column:
    m = F.lower(module)
    return _ladder([(m.contains(client) | m.contains(server), F.lit(name))
                    for name, client, server in SLICE_TOKENS])


def cell_of(module: Column) -> Column:
    m = F.lower(module)
    app = F.regexp_extract(module, r"\.app\[(\d+)\]", 1)
    by_app = _ladder([(app == str(i), F.lit(cell)) for cell, i in SERVER_APPS])
    return _ladder(
        [(m.contains(token), F.lit(cell)) for cell, token in CELL_SUFFIXES]
        + [(m.contains("server") & (app != ""), F.coalesce(by_app, F.lit("Macro")))]
        + [(m.contains(token), F.lit(cell)) for cell, token in CELL_PATHS])


def is_relevant(module: Column, signal: Column) -> Column:
    """Server-side signals, and only the sent-packet signal of the client side."""
    server = F.lower(module).contains("server")
    return ((server | signal.contains("cbrSentPkt"))
            & slice_of(module).isNotNull() & cell_of(module).isNotNull())


def run_of(path: Column, extension: str) -> Column:
    """Run name: the path element with the extension, without folder; null where there is none.
    The element may be one file or a folder of part files, which the writer of logs names
    ``log=<run>.<extension>`` with its own escapes. Any other "=" belongs to the name.
    Evaluated for every line of a log, hence plain string functions and no pattern."""
    full, mark = F.concat(path, F.lit("/")), f".{extension}/"
    name = F.substring_index(F.substring_index(full, mark, 1), "/", -1)
    own = name.startswith(PART_PREFIX)
    return F.when(full.contains(mark), F.when(
        own, decoded(F.substring(name, F.lit(len(PART_PREFIX) + 1), F.length(name)))).otherwise(name))


def decoded(path: Column) -> Column:
    """Percent escapes of a path resolved; paths without any are left alone."""
    plain = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(path, F.lit("%")), F.url_decode(plain)).otherwise(path)


def scenario_of(run: Column) -> Column:
    """Run name without its last dash part."""
    return F.regexp_replace(run, "-[^-]*$", "")


def label_of(gnb: Column, slice_: Column) -> Column:
    return F.concat_ws("_", gnb, slice_)
