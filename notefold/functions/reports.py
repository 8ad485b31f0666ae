"""Reports for people, as text columns; lines of null values are left out. The wording is this package's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.runtime import interval, listed, report, yes_no

#: Lines of a log that a report ends with.
TAIL = 6


def _text(value: Column) -> Column:
    return value.cast("string")


def _or(value: Column, none: str) -> Column:
    return F.coalesce(_text(value), F.lit(none))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else _text(p) for p in parts))


def scheduler_report(mode: Column, minutes: Column, next_run: Column, last_message: Column, active: Column, last_run: Column) -> Column:
    """When runs start: by hand, or at intervals with the next start; and how the last one went, once there was one."""
    timed = mode.eqNullSafe("interval")
    start = F.when(timed, _joined("every ", interval(minutes), " min, next at ", _or(next_run, "no set time"))).otherwise("by hand")
    return report(("Start of runs", start), ("A run is under way", yes_no(active)), ("Latest run", last_run), ("It said", last_message))


def pending_report(available: Column, reason: Column, current: Column, every: Column, metrics: Column) -> Column:
    """current, every: structs (total, items); metrics: struct (ms, listed, scanned, updated)."""
    scope = lambda s: _joined(s["total"], " to do; newest: ", listed(s["items"]))
    work = _joined(metrics["scanned"], " of ", metrics["listed"], " files read, ", metrics["updated"], " new, in ", metrics["ms"], " ms")
    return F.when(available, report(("Chosen folders", scope(current)), ("Every folder", scope(every)), ("Counted from", work))).otherwise(report(("Work to do is not known", reason)))


def scope_report(complete: Column, config: Column, current: Column, every: Column, guidance: Column) -> Column:
    return F.concat_ws("\n", guidance, report(("Chosen folders", listed(current)), ("Every folder", listed(every)), ("Choice is complete", yes_no(complete)), ("Kept in", _or(config, "no file"))))


def diagnostics_report(running: Column, last: Column, result: Column, log: Column) -> Column:
    """result: struct (ok, summary, checks: array of (label, status, message, guidance)), null before any preflight; log: lines, of which the last TAIL are told."""
    check = lambda c: F.concat_ws(" > ", _joined("- ", c["label"], " is ", c["status"], ", ", c["message"]), F.nullif(c["guidance"], F.lit("")))
    verdict = F.when(result.isNull(), "nothing was checked so far").otherwise(_joined(F.when(result["ok"], "runs can start").otherwise("runs cannot start"), ", ", result["summary"]))
    tail = F.when(F.size(log) > 0, F.concat_ws("\n", F.lit("End of the log:"), F.slice(log, F.greatest(F.size(log) - TAIL + 1, F.lit(1)), F.lit(TAIL))))
    return F.concat_ws("\n", report(("Checks", verdict), ("Made at", last), ("Being made now", yes_no(running))), F.transform(result["checks"], check), tail)


def runtime_notice(problem: Column, trust: Column, runs: Column, mode: Column, next_run: Column, pending: Column, preflight: Column, scopes: Column) -> Column:
    """One line on the whole state, or the problem that keeps runs from starting.

    runs: array of (name, command); pending: struct (available, reason, current,
    every); preflight: struct (ok, summary), null before any; scopes: struct
    (complete, current, every, guidance).
    """
    parts = {
        "to do": F.when(pending["available"], _joined(pending["current"], " chosen, ", pending["every"], " in all")).otherwise(_joined("unknown, ", pending["reason"])),
        "next run": F.when(mode.eqNullSafe("interval"), _or(next_run, "at no set time")).otherwise("by hand"),
        "checks": F.when(preflight.isNull(), "none yet").otherwise(_joined(F.when(preflight["ok"], "passed, ").otherwise("not passed, "), preflight["summary"])),
        "folders": F.when(scopes["complete"], _joined(scopes["current"], " chosen, ", scopes["every"], " in all")).otherwise(_joined("not chosen, ", scopes["guidance"])),
        "commands": F.array_join(F.transform(runs, lambda r: _joined(r["command"], " for ", r["name"])), ", "),
        "trust": trust,
    }
    return F.coalesce(problem, F.concat_ws(" | ", *(_joined(f"{name}: ", value) for name, value in parts.items())))
