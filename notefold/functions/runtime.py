"""Column functions on scopes, schedules, preflight output, runtime paths and status lines; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.text import inside, lexical, strip

# Least interval of the scheduler (minutes) and its default, arguments that runs accept, required assets, roots of old and new installs.
MIN_INTERVAL = 5
DEFAULT_INTERVAL = 60
RUN_ARGS = ("--preflight", "--current", "--all", "--apply", "--refresh-all", "--preview", "--apply-preview", "--rebuild", "--quiet", "--index", "--tag")
RUN_PROFILES = {"current": (("--current", "--apply"), "current scope"), "all": (("--all", "--apply"), "all scopes")}
CONFIG_NAME = "config.json"
CONFIG_TEMPLATE = "config.template.json"
OLD_ROOT, NEW_ROOT = "../..", "../../../../"

_CHECK = "struct<code:string,label:string,status:string,message:string,guidance:string>"


# ---- scopes


def scope_path(path: Column) -> Column:
    """A scope's folder with forward slashes and no empty or '.' parts; '.' for the root; null if it climbs, or is nothing but dots and slashes."""
    slashed = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda s: ~s.isin("", "."))
    return F.when(slashed.isin("", "/", "."), ".").when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def scope_paths(paths: Column) -> Column:
    """Usable folders of a scope, once each, the root first, the others in Unicode order."""
    own = F.array_distinct(F.filter(F.transform(paths, scope_path), lambda p: p.isNotNull()))
    keyed = F.transform(own, lambda p: F.struct((p != ".").alias("below"), F.collate(p, "UNICODE").alias("by"), p.alias("path")))
    return F.transform(F.array_sort(keyed), lambda e: e["path"])


def folder_options(folders: Column, config_dir: Column, root_label: str = "Vault root") -> Column:
    """(value, label) of the root and every folder but the configuration folder and what lies in it."""
    shown = F.filter(scope_paths(F.concat(F.array(F.lit(".")), folders)), lambda p: (p != config_dir) & ~F.startswith(p, F.concat(config_dir, F.lit("/"))))
    return F.transform(shown, lambda p: F.struct(p.alias("value"), F.when(p == ".", root_label).otherwise(p).alias("label")))


def chosen_scope(mode: Column, config: Column) -> Column:
    """Folders a run scans, from a config struct (notes_paths_all, notes_paths_current, notes_paths, notes_path); null entries are absent."""
    plain = F.coalesce(config["notes_paths"], F.array(config["notes_path"]))
    return F.coalesce(F.when(mode == "all", config["notes_paths_all"]).when(mode == "current", config["notes_paths_current"]), plain)


def pending_scope(mode: Column, config: Column) -> Column:
    """Folders whose pending notes are counted: current falls back to notes_paths, then to nothing; all to current if it is absent or empty."""
    current = F.coalesce(config["notes_paths_current"], config["notes_paths"], F.array().cast("array<string>"))
    return F.when((mode == "all") & (F.coalesce(F.size(config["notes_paths_all"]), F.lit(0)) > 0), config["notes_paths_all"]).otherwise(current)


def scope_setup(valid: Column, managed: Column, current: Column, every: Column, error: Column) -> Column:
    """(complete, can_manage, guidance) of the scope setup: what is wrong first decides."""
    both = (F.size(current) > 0) & (F.size(every) > 0)
    guidance = F.when(~valid, F.coalesce(error, F.lit("The runtime is not ready."))).when(~managed, "Only the bundled config can be changed here.").when(~both, "Select folders for both scopes.").otherwise("Scopes are set up.")
    return F.struct((valid & managed & both).alias("complete"), (valid & managed).alias("can_manage"), guidance.alias("guidance"))


# ---- schedules and settings


def interval(minutes: Column) -> Column:
    """Whole minutes, rounded half up, at least MIN_INTERVAL; what is not a finite number gives the least."""
    finite = minutes.isNotNull() & ~F.isnan(minutes) & (F.abs(minutes) != float("inf"))
    return F.when(finite, F.greatest(F.lit(MIN_INTERVAL).cast("long"), F.floor(minutes + 0.5))).otherwise(F.lit(MIN_INTERVAL).cast("long"))


def next_run(mode: Column, minutes: Column, now_ms: Column) -> Column:
    """When an interval scheduler runs next (ms); null for manual runs."""
    return F.when(mode == "interval", now_ms + interval(minutes) * 60_000)


def scheduler_action(mode: Column, running: Column) -> Column:
    return F.when(~mode.eqNullSafe("interval"), "skip-disabled").when(running, "skip-running").otherwise("run")


def merged_settings(stored: Column) -> Column:
    """Stored settings (python_command, script_path, config_path, mode, minutes) over the defaults; the interval is normalised."""
    or_else = lambda name, value: F.coalesce(stored[name], F.lit(value)).alias(name)
    return F.struct(or_else("python_command", "python3"), or_else("script_path", ""), or_else("config_path", ""), or_else("mode", "manual"), interval(F.coalesce(stored["minutes"].cast("double"), F.lit(float(DEFAULT_INTERVAL)))).alias("minutes"))


def refused_args(args: Column) -> Column:
    """Arguments that a run does not accept, in order."""
    return F.filter(args, lambda a: ~a.isin(*RUN_ARGS))


def command_line(parts: Column) -> Column:
    """Parts joined by blanks; those with a blank as JSON strings."""
    quoted = lambda p: F.concat(F.lit('"'), F.regexp_replace(p, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(" ")), quoted(p)).otherwise(p)), " ")


# ---- installs


def missing_assets(required: Column, present: Column, writable: Column) -> Column:
    """(recovered, config_created, ok): assets to restore, and whether the config has to be made from its template; nothing where the folder cannot be written."""
    absent = F.array_except(required, present)
    none = F.array().cast("array<string>")
    no_config = ~F.array_contains(present, CONFIG_NAME)
    return F.struct(F.when(writable, absent).otherwise(none).alias("recovered"), (writable & no_config).alias("config_created"), (writable | ((F.size(absent) == 0) & ~no_config)).alias("ok"))


def migrated_root(config: Column, prefix: Column) -> Column:
    """vault_root of a config struct: the new root if it is the old one and database, state and log all lie under prefix."""
    managed = F.startswith(config["db_path"], prefix) & F.startswith(config["state_path"], prefix) & F.startswith(config["log_path"], prefix)
    return F.when((config["vault_root"] == OLD_ROOT) & managed, NEW_ROOT).otherwise(config["vault_root"])


# ---- runtime paths


def _file(raw: Column, defaults: list[Column], root: Column, files: Column) -> Column:
    """(path, problem) of a script or config setting: relative to the root and inside it, or blank for the first default that exists."""
    own = strip(raw)
    default = F.coalesce(*[F.when(F.array_contains(files, d), d) for d in defaults], defaults[0])
    path = F.when(own == "", default).when(F.startswith(own, F.lit("/")), lexical(own)).otherwise(lexical(F.concat(root, F.lit("/"), own)))
    problem = F.when(F.startswith(own, F.lit("/")), "ABSOLUTE").when(~inside(path, root), "OUTSIDE").when(~F.array_contains(files, path), "MISSING")
    return F.struct(path.alias("path"), problem.alias("problem"))


def _command(raw: Column, root: Column, files: Column) -> Column:
    """(path, problem) of an interpreter setting: blank, a bare name, or a file."""
    own = strip(raw)
    direct = own.rlike(r"[/\\]")
    path = F.when(own == "", "python3").when(~direct, own).when(F.startswith(own, F.lit("/")), lexical(own)).otherwise(lexical(F.concat(root, F.lit("/"), own)))
    problem = F.when(own.rlike(r"""["'`;&|<>\n\r]"""), "METACHARACTER").when(~direct & (own != "") & ~own.rlike("^[A-Za-z0-9._-]+$"), "NOT_ONE_NAME").when(direct & ~F.startswith(own, F.lit("/")) & ~inside(path, root), "OUTSIDE").when(direct & ~F.array_contains(files, path), "MISSING")
    return F.struct(path.alias("path"), problem.alias("problem"))


def runtime(python: Column, script: Column, config: Column, root: Column, plugin_dir: Column, files: Column, script_name: str) -> Column:
    """(command, script, config, trust, valid, reasons) of runtime settings; files: existing files (a listing of one install).

    command, script and config are (path, problem), problem null if there is
    none.  trust: blocked with any problem, caution if the interpreter is given
    as a path or a file lies outside the plugin's own folder, else trusted.
    """
    own = F.concat(plugin_dir, F.lit("/python"))
    at = lambda name: F.concat(own, F.lit(f"/{name}"))
    c, s, k = _command(python, root, files), _file(script, [at(script_name)], root, files), _file(config, [at(CONFIG_NAME), at(CONFIG_TEMPLATE)], root, files)
    valid = c["problem"].isNull() & s["problem"].isNull() & k["problem"].isNull()
    reasons = F.array_compact(F.array(F.when(python.rlike(r"[/\\]"), "direct interpreter"), F.when(~inside(s["path"], own), "custom script"), F.when(~inside(k["path"], own), "custom config")))
    trust = F.when(~valid, "blocked").when(F.size(reasons) > 0, "caution").otherwise("trusted")
    return F.struct(c.alias("command"), s.alias("script"), k.alias("config"), trust.alias("trust"), valid.alias("valid"), reasons.alias("reasons"))


# ---- preflight


def log_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda x: x != "")


def _is(value: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant")) == kind


def _payload(line: Column) -> Column:
    """Whether a line is a JSON object of the preflight's shape."""
    v = F.try_parse_json(line)
    checks = F.try_variant_get(v, "$.checks", "array<variant>")
    fine = F.forall(checks, lambda c: _is(c, "$.code", "STRING") & _is(c, "$.label", "STRING") & _is(c, "$.message", "STRING") & F.try_variant_get(c, "$.status", "string").isin("ok", "error"))
    path = F.try_variant_get(v, "$.config_path", "variant")
    return F.coalesce(_is(v, "$.ok", "BOOLEAN") & _is(v, "$.summary", "STRING") & fine & (path.isNull() | (F.schema_of_variant(path) == "STRING")), F.lit(False))


def _one_check(code: Column | str, message: Column, guidance: Column | str) -> Column:
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.array(F.struct(as_col(code).alias("code"), F.lit("Preflight execution").alias("label"), F.lit("error").alias("status"), message.alias("message"), as_col(guidance).alias("guidance")))


def preflight_result(stdout: Column, stderr: Column) -> Column:
    """(ok, summary, checks, config_path): the last line of stdout that is a result, else one check with what was said."""
    line = F.try_element_at(F.filter(log_lines(stdout), _payload), F.lit(-1))
    said = F.coalesce(F.nullif(strip(stderr), F.lit("")), F.nullif(strip(stdout), F.lit("")), F.lit("The preflight gave no structured output."))
    good = F.from_json(line, f"ok boolean, summary string, checks array<{_CHECK}>, config_path string")
    bad = F.struct(F.lit(False).alias("ok"), said.alias("summary"), _one_check("PREFLIGHT_OUTPUT_INVALID", said, "Read the error output and run the preflight again.").alias("checks"), F.lit(None).cast("string").alias("config_path"))
    return F.when(line.isNotNull(), good).otherwise(bad)


def spawn_failure(error: Column, command: Column, message: Column) -> Column:
    """The result of a preflight that could not start."""
    absent = error == "ENOENT"
    said = F.when(absent, F.concat(F.lit("Interpreter not found: "), command)).otherwise(F.concat(F.lit("The preflight did not start: "), message))
    guidance = F.when(absent, "Install it or change the setting.").otherwise("Check the setting and the permissions.")
    code = F.when(absent, "PYTHON_EXECUTABLE_MISSING").otherwise("PYTHON_EXECUTION_FAILED")
    return F.struct(F.lit(False).alias("ok"), said.alias("summary"), _one_check(code, said, guidance).alias("checks"), F.lit(None).cast("string").alias("config_path"))


def preflight_notice(result: Column) -> Column:
    """The summary, or the first failed check's message and guidance."""
    bad = F.try_element_at(F.filter(result["checks"], lambda c: c["status"] == "error"), F.lit(1))
    return F.when(result["ok"] | bad.isNull(), result["summary"]).otherwise(F.concat_ws(" ", bad["message"], F.nullif(bad["guidance"], F.lit(""))))


# ---- status lines


def status(running: Column, checking: Column, ok: Column, complete: Column, mode: Column, pending: Column, next_run: Column) -> Column:
    """What a status line says; the first state that holds decides. ok is null before any preflight, pending where it is not known."""
    waiting = F.concat(pending.cast("string"), F.lit(" pending"))
    return (
        F.when(running, "running").when(checking, "preflight").when(F.coalesce(~ok, F.lit(False)), "preflight failed").when(~complete, "scope setup required")
        .when(mode == "interval", F.concat(F.coalesce(waiting, F.lit("pending n/a")), F.lit(" • next "), F.coalesce(next_run, F.lit("Not scheduled")))).otherwise(F.coalesce(waiting, F.lit("manual")))
    )


def report(*lines: tuple[str, Column]) -> Column:
    """Lines 'name: value'; a null value leaves its line out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in lines])


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def listed(items: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit("None"))
