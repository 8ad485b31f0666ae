"""Registered queries of configuration, schedules, preflight, writes and the model client, with DuckDB SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions import frontmatter as Y
from notefold.functions import reports as REP
from notefold.functions import runtime as R
from notefold.functions import text as T
from notefold.operators import fuzzy
from notefold.operators import model as M
from notefold.operators import notes as N
from notefold.operators import writes as W
from notefold.operators.preflight import preflight_checks as checked
from notefold.plans import run
from notefold.plans.queries import _CHUNKS, _EVENTS, _NOTES, _STATE, _TAGS, _links_sql, _tags, query, select_links
from notefold.sources import config as C
from notefold.sources import notes as src

NL = "chr(10)"


def _text(c):
    return F.col(c).cast("string")


# ---- scopes and configuration


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CONFIG_MISSING' WHEN 1 THEN 'CONFIG_INVALID' WHEN 2 THEN 'CONFIG_EMPTY' ELSE 'CONFIG_OK' END AS code FROM documents""")
def load_config(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 1, "{broken").when(F.col("doc_id") % 8 == 2, "{}").when(F.col("doc_id") % 4 == 2, "[1]").when(F.col("doc_id") % 4 == 3, F.concat(F.lit('{"id":'), _text("doc_id"), F.lit("}")))
    return src.load(spark, d, "documents").select("doc_id", C.config_code(raw).alias("code"))


_CONFIGS = """c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, n_name || '/a'] END AS every, CASE WHEN n_nationkey % 3 = 0 THEN ['cur'] END AS cur, CASE WHEN n_nationkey % 5 <> 0 THEN ['plain', n_name] END AS plain, n_name AS single FROM nation)"""


def _configs(spark, d):
    k = F.col("n_nationkey")
    config = F.struct(
        F.when(k % 2 == 0, F.array("n_name", F.concat("n_name", F.lit("/a")))).alias("notes_paths_all"), F.when(k % 3 == 0, F.array(F.lit("cur"))).alias("notes_paths_current"),
        F.when(k % 5 != 0, F.array(F.lit("plain"), "n_name")).alias("notes_paths"), F.col("n_name").alias("notes_path"),
    )
    return src.load(spark, d, "nation").select(k.alias("k"), config.alias("config"))


@query(f"""WITH {_CONFIGS}, m AS (SELECT unnest(['all', 'current', 'none']) AS mode) SELECT k, mode, array_to_string(CASE WHEN mode = 'all' AND every IS NOT NULL THEN every WHEN mode = 'current' AND cur IS NOT NULL THEN cur WHEN plain IS NOT NULL THEN plain ELSE [single] END, ',') AS folders,
array_to_string(CASE WHEN mode = 'all' AND every IS NOT NULL THEN every ELSE coalesce(cur, plain, []) END, ',') AS pending FROM c, m""")
def scope_fallback(spark, d):
    each = _configs(spark, d).select("k", "config", F.explode(F.array(*map(F.lit, ("all", "current", "none")))).alias("mode"))
    return each.select("k", "mode", F.array_join(R.chosen_scope(F.col("mode"), F.col("config")), ",").alias("folders"), F.array_join(R.pending_scope(F.col("mode"), F.col("config")), ",").alias("pending"))


@query("""WITH p AS (SELECT p_partkey, unnest(['.', lower(replace(p_name, ' ', '/')), lower(p_name)]) AS x FROM part), o AS (SELECT DISTINCT p_partkey, x FROM p) SELECT p_partkey, string_agg(x, ',' ORDER BY x <> '.', replace(replace(x, ' ', '!'), '/', '(')) AS folders FROM o GROUP BY p_partkey""")
def scope_sort(spark, d):
    name = F.lower("p_name")
    paths = F.array(name, F.replace(name, F.lit(" "), F.lit("\\")), F.lit("../x"), F.lit(" ./ "), F.lit("."), F.concat(F.lit("/"), name, F.lit("//")))
    return src.load(spark, d, "part").select("p_partkey", F.array_join(R.scope_paths(paths), ",").alias("folders"))


@query("""SELECT n_nationkey, 'Vault root' AS first_label, CAST(2 AS INTEGER) AS n, lower(n_name) AS second FROM nation""")
def folder_options(spark, d):
    shown = R.folder_options(F.array(F.lit(".conf"), F.lit(".conf/plugins"), F.lower("n_name")), F.lit(".conf"))
    return src.load(spark, d, "nation").select("n_nationkey", shown[0]["label"].alias("first_label"), F.size(shown).alias("n"), shown[1]["value"].alias("second"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 3 THEN '{"kept":7,"notes_paths":["' || n_name || '"],"notes_paths_current":["' || n_name || '"],"notes_paths_all":[".","' || n_name || '"]}' END AS config FROM nation""")
def scope_config_update(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    raw = F.when(k % 8 == 3, "[1]").otherwise('{"notes_paths_all": ["old"], "kept": 7}')
    current = F.when(k % 8 == 7, F.array(F.lit("../no"))).otherwise(F.array(F.concat(F.lit("/"), name), F.concat(name, F.lit("/."))))
    return src.load(spark, d, "nation").select("n_nationkey", C.updated_scopes(raw, current, F.array(name, F.lit("/"), name)).alias("config"))


@query("""SELECT n_nationkey, n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AND n_nationkey % 5 <> 0 AS complete, n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AS can_manage,
CASE WHEN n_nationkey % 2 <> 0 THEN n_name WHEN n_nationkey % 3 <> 0 THEN 'Only the bundled config can be changed here.' WHEN n_nationkey % 5 = 0 THEN 'Select folders for both scopes.' ELSE 'Scopes are set up.' END AS guidance FROM nation""")
def scope_setup_status(spark, d):
    k = F.col("n_nationkey")
    own = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name"))
    s = R.scope_setup(k % 2 == 0, k % 3 == 0, own, F.array("n_name"), F.col("n_name"))
    return src.load(spark, d, "nation").select("n_nationkey", s["complete"].alias("complete"), s["can_manage"].alias("can_manage"), s["guidance"].alias("guidance"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN '../../../../' WHEN n_nationkey % 2 = 0 THEN '../..' ELSE n_name END AS vault_root FROM nation""")
def config_migration(spark, d):
    k, own = F.col("n_nationkey"), F.lit(".conf/plugins/p/")
    config = F.struct(
        F.when(k % 2 == 0, "../..").otherwise(F.col("n_name")).alias("vault_root"), F.concat(own, F.lit("db")).alias("db_path"), F.concat(own, F.lit("state.json")).alias("state_path"),
        F.when(k % 3 == 0, F.concat(own, F.lit("log"))).otherwise("elsewhere").alias("log_path"),
    )
    return src.load(spark, d, "nation").select("n_nationkey", R.migrated_root(config, own).alias("vault_root"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a.py,b.txt' WHEN 1 THEN 'b.txt' ELSE '' END AS recovered, n_nationkey % 4 IN (0, 1) AS config_created, n_nationkey % 4 <> 3 AS ok FROM nation""")
def runtime_assets(spark, d):
    k = F.col("n_nationkey") % 4
    present = F.when(k == 1, F.array(F.lit("a.py"))).when(k == 2, F.array(*map(F.lit, ("a.py", "b.txt", R.CONFIG_NAME)))).otherwise(F.array().cast("array<string>"))
    r = R.missing_assets(F.array(F.lit("a.py"), F.lit("b.txt")), present, k != 3)
    return src.load(spark, d, "nation").select("n_nationkey", F.array_join(r["recovered"], ",").alias("recovered"), r["config_created"].alias("config_created"), r["ok"].alias("ok"))


@query(f"WITH {_NOTES}, {_STATE} SELECT relpath, hash FROM state")
def state_file(spark, d):
    entry = F.to_json(F.struct(F.create_map(F.replace("relpath", F.lit("/"), F.lit("\\")), F.struct("hash")).alias("files")))
    return src.state(spark, d).select(F.inline(C.state_of(entry))).select("relpath", "hash")


@query("""SELECT 'a' || n_nationkey AS alias, n_name AS canonical FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 'c' || n_nationkey FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'shared', n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 3 = 0)""")
def tag_alias_source(spark, d):
    k = F.col("n_nationkey")
    listed = F.to_json(F.create_map("n_name", F.array(F.concat(F.lit("a"), k.cast("string")), F.lit("shared"), F.lit(""))))
    raw = F.when(k % 3 == 0, listed).when(k % 3 == 1, F.to_json(F.create_map("n_name", F.concat(F.lit("c"), k.cast("string"))))).otherwise('{"n": 3}')
    return C.tag_aliases(src.load(spark, d, "nation").select(k.alias("seq"), raw.alias("raw")))


@query("SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS tag FROM part")
def controlled_tags_source(spark, d):
    raw = src.load(spark, d, "part").select("p_type").distinct().agg(F.to_json(F.collect_set("p_type")).alias("raw"))  # a vocabulary: 150 types at any scale
    return raw.select(F.explode(F.from_json("raw", "array<string>")).alias("t")).select(T.normalize_tag(F.col("t")).alias("tag")).distinct()


# ---- schedules, settings, status


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'skip-disabled' WHEN event_id % 3 = 0 THEN 'skip-running' ELSE 'run' END AS action FROM events""")
def interval_scheduler(spark, d):
    mode = F.when(F.col("event_type") == "view", "manual").otherwise("interval")
    return src.load(spark, d, "events").select("event_id", R.scheduler_action(mode, F.col("event_id") % 3 == 0).alias("action"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'py' ELSE 'python3' END AS python_command, CASE WHEN event_id % 5 = 0 THEN 60 ELSE greatest(5, CAST(floor(value + 0.5) AS BIGINT)) END AS minutes FROM events""")
def settings_merge(spark, d):
    k = F.col("event_id")
    stored = F.struct(F.when(k % 2 == 0, "py").alias("python_command"), *[F.lit(None).cast("string").alias(x) for x in ("script_path", "config_path", "mode")], F.when(k % 5 != 0, F.col("value")).alias("minutes"))
    m = R.merged_settings(stored)
    return src.load(spark, d, "events").select("event_id", m["python_command"].alias("python_command"), m["minutes"].alias("minutes"))


_STATUS = """CASE WHEN conv_id % 7 = 0 THEN 'running' WHEN conv_id % 7 = 1 THEN 'preflight' WHEN conv_id % 7 = 2 THEN 'preflight failed' WHEN conv_id % 7 = 3 THEN 'scope setup required'
WHEN conv_id % 7 = 4 THEN turn || ' pending • next t' || turn WHEN conv_id % 7 = 5 THEN turn || ' pending' ELSE 'manual' END"""


def _status(k, turn):
    return R.status(k == 0, k <= 1, F.when(k == 2, False), k > 3, F.when(k == 4, "interval").otherwise("manual"), F.when(k != 6, turn), F.concat(F.lit("t"), turn.cast("string")))


@query(f"SELECT conv_id, turn, {_STATUS} AS status FROM conversations")
def status_priority(spark, d):
    return src.load(spark, d, "conversations").select("conv_id", "turn", _status(F.col("conv_id") % 7, F.col("turn")).alias("status"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'None' ELSE role || ', b' END AS items, CASE WHEN conv_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS yes, conv_id % 2 = 0 AS even FROM conversations)
SELECT conv_id, turn,
    'Start of runs: ' || CASE WHEN even THEN 'every ' || greatest(5, turn) || ' min, next at ' || conv_id ELSE 'by hand' END || {NL} || 'A run is under way: ' || yes || CASE WHEN turn % 3 = 0 THEN {NL} || 'Latest run: ' || turn ELSE '' END || {NL} || 'It said: ' || role AS scheduler,
    CASE WHEN turn % 3 = 0 THEN 'Work to do is not known: ' || role ELSE 'Chosen folders: ' || turn || ' to do; newest: ' || items || {NL} || 'Every folder: ' || (turn + 1) || ' to do; newest: None' || {NL} || 'Counted from: 3 of 4 files read, 2 new, in ' || conv_id || ' ms' END AS pending,
    'do ' || role || {NL} || 'Chosen folders: ' || items || {NL} || 'Every folder: None' || {NL} || 'Choice is complete: ' || yes || {NL} || 'Kept in: ' || CASE WHEN turn % 3 = 0 THEN 'no file' ELSE role END AS scopes,
    'Checks: ' || CASE WHEN turn % 3 = 0 THEN 'nothing was checked so far' ELSE CASE WHEN even THEN 'runs can start' ELSE 'runs cannot start' END || ', s' || turn || {NL} || 'Made at: ' || turn END || {NL} || 'Being made now: ' || yes || CASE WHEN turn % 3 = 0 THEN '' ELSE {NL} || '- ' || role || ' is ok, m' || CASE WHEN even THEN ' > g' ELSE '' END END || CASE WHEN turn % 2 = 0 THEN {NL} || 'End of the log:' || {NL} || '2' || {NL} || '3' || {NL} || '4' || {NL} || '5' || {NL} || '6' || {NL} || '7' ELSE '' END AS diagnostics,
    CASE WHEN turn % 5 = 4 THEN 'no ' || role ELSE 'to do: ' || CASE WHEN turn % 3 = 0 THEN 'unknown, ' || role ELSE turn || ' chosen, ' || (turn + 1) || ' in all' END || ' | next run: ' || CASE WHEN even THEN CAST(conv_id AS VARCHAR) ELSE 'by hand' END || ' | checks: ' || CASE WHEN turn % 3 = 0 THEN 'none yet' ELSE CASE WHEN even THEN 'passed' ELSE 'not passed' END || ', s' || turn END || ' | folders: ' || CASE WHEN even THEN '2 chosen, ' || turn || ' in all' ELSE 'not chosen, do ' || role END || ' | commands: a --x for current, b for all | trust: ' || role END AS notice
FROM c""")
def status_reports(spark, d):
    k, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    even, third, none = k % 2 == 0, turn % 3 == 0, F.array().cast("array<string>")
    items, do = F.when(turn % 2 == 0, none).otherwise(F.array(role, F.lit("b"))), F.concat(F.lit("do "), role)
    mode = F.when(even, "interval").otherwise("manual")
    summary = F.concat(F.lit("s"), turn.cast("string"))
    checks = F.array(F.struct(role.alias("label"), F.lit("ok").alias("status"), F.lit("m").alias("message"), F.when(even, "g").otherwise("").alias("guidance")))
    log = F.when(turn % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(7)), lambda x: x.cast("string"))).otherwise(none)
    metrics = F.struct(k.alias("ms"), F.lit(4).alias("listed"), F.lit(3).alias("scanned"), F.lit(2).alias("updated"))
    runs = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("command")) for a, b in (("current", "a --x"), ("all", "b"))])
    return src.load(spark, d, "conversations").select(
        "conv_id", "turn",
        REP.scheduler_report(mode, turn.cast("double"), k, role, even, F.when(third, turn)).alias("scheduler"),
        REP.pending_report(~third, role, F.struct(turn.alias("total"), items.alias("items")), F.struct((turn + 1).alias("total"), none.alias("items")), metrics).alias("pending"),
        REP.scope_report(even, F.when(~third, role), items, none, do).alias("scopes"),
        REP.diagnostics_report(even, F.when(~third, turn), F.when(~third, F.struct(even.alias("ok"), summary.alias("summary"), checks.alias("checks"))), log).alias("diagnostics"),
        REP.runtime_notice(F.when(turn % 5 == 4, F.concat(F.lit("no "), role)), role, runs, mode, k, F.struct((~third).alias("available"), role.alias("reason"), turn.alias("current"), (turn + 1).alias("every")), F.when(~third, F.struct(even.alias("ok"), summary.alias("summary"))), F.struct(even.alias("complete"), F.lit(2).alias("current"), turn.alias("every"), do.alias("guidance"))).alias("notice"),
    )


@query(f"WITH {_EVENTS} SELECT path, count(*) AS n FROM ev GROUP BY path")
def run_progress(spark, d):
    return src.vault_events(spark, d).groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT '[' || upper(role) || '] ' || conv_id || CASE WHEN turn % 2 = 0 THEN ' turn ' || turn ELSE '' END AS value FROM conversations""")
def run_log(spark, d):
    steps = src.load(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("seq"), F.upper("role").alias("code"), _text("conv_id").alias("note"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), _text("turn"))).alias("msg"))
    return C.run_log(steps)


@query("""SELECT conv_id, turn, 'a' || turn || '|b' AS lines FROM conversations""")
def split_log_lines(spark, d):
    said = F.concat(F.lit(" a"), _text("turn"), F.lit(" \r\n\n \nb\n"))
    return src.load(spark, d, "conversations").select("conv_id", "turn", F.array_join(R.log_lines(said), "|").alias("lines"))


# ---- preflight and paths


def _preflight(spark, d):
    k = F.col("turn") % 4
    good = lambda ok, status: F.concat(F.lit('{"ok":' + ok + ',"summary":"s'), _text("turn"), F.lit('","checks":[{"code":"C","label":"L","status":"' + status + '","message":"m","guidance":"g"}]}'))
    out = F.when(k == 0, F.concat(F.lit("noise\n"), good("true", "ok"), F.lit("\nlater"))).when(k == 1, good("false", "error")).when(k == 2, '{"ok":"yes","summary":"x","checks":[]}').otherwise("")
    err = F.when(k == 2, F.concat(F.lit(" bad "), _text("turn"))).otherwise("")
    return src.load(spark, d, "conversations").select("conv_id", "turn", R.preflight_result(out, err).alias("r"))


@query("""SELECT conv_id, turn, turn % 4 = 0 AS ok, CASE turn % 4 WHEN 2 THEN 'bad ' || turn WHEN 3 THEN 'The preflight gave no structured output.' ELSE 's' || turn END AS summary, CASE WHEN turn % 4 < 2 THEN 'C' ELSE 'PREFLIGHT_OUTPUT_INVALID' END AS code FROM conversations""")
def preflight_parse(spark, d):
    return _preflight(spark, d).select("conv_id", "turn", "r.ok", "r.summary", F.col("r.checks")[0]["code"].alias("code"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 's' || turn WHEN 1 THEN 'm g' WHEN 2 THEN 'bad ' || turn || ' Read the error output and run the preflight again.' ELSE 'The preflight gave no structured output. Read the error output and run the preflight again.' END AS notice FROM conversations""")
def preflight_notice(spark, d):
    return _preflight(spark, d).select("conv_id", "turn", R.preflight_notice(F.col("r")).alias("notice"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'PYTHON_EXECUTABLE_MISSING' ELSE 'PYTHON_EXECUTION_FAILED' END AS code, CASE WHEN turn % 2 = 0 THEN 'Interpreter not found: py' ELSE 'The preflight did not start: ' || role END AS summary FROM conversations""")
def spawn_failure_map(spark, d):
    r = R.spawn_failure(F.when(F.col("turn") % 2 == 0, "ENOENT").otherwise("EACCES"), F.lit("py"), F.col("role"))
    return src.load(spark, d, "conversations").select("conv_id", "turn", r["checks"][0]["code"].alias("code"), r["summary"].alias("summary"))


@query("""WITH m AS (SELECT count(*) FILTER (n_name = 'FRANCE') > 0 AS first, count(*) FILTER (n_name = 'NOWHERE') > 0 AS second FROM nation)
SELECT code, status FROM (VALUES ('PYTHON_RUNTIME_OK', 'ok'), ('DEPENDENCY_PYARROW_OK', 'ok'), ('CONFIG_OK', 'ok'), ('OLLAMA_REACHABLE', 'ok')) v(code, status)
UNION ALL SELECT CASE WHEN first AND second THEN 'OLLAMA_MODELS_OK' ELSE 'OLLAMA_MODELS_MISSING' END, CASE WHEN first AND second THEN 'ok' ELSE 'error' END FROM m""")
def preflight_checks(spark, d):
    have = [f"{r.n_name}:latest" for r in src.load(spark, d, "nation").select("n_name").collect()]  # 25 nations stand for a server's models
    config = '{"ollama_base_url": "http://server", "embed_model": "FRANCE:7b", "llm_model": "NOWHERE"}'
    return checked(spark, config, lambda url: have, needs=("pyarrow",)).select("code", "status")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'trusted' WHEN 1 THEN 'caution' ELSE 'blocked' END AS trust,
CASE doc_id % 6 WHEN 2 THEN 'OUTSIDE' WHEN 3 THEN 'ABSOLUTE' WHEN 4 THEN 'METACHARACTER' WHEN 5 THEN 'NOT_ONE_NAME' END AS problem, CASE doc_id % 6 WHEN 1 THEN '/vault/tools/py' WHEN 4 THEN 'python3; ls' WHEN 5 THEN 'python3 -c' ELSE 'python3' END AS command FROM documents""")
def path_trust(spark, d):
    k = F.col("doc_id") % 6
    python = F.when(k == 1, "tools/./py").when(k == 4, "python3; ls").when(k == 5, "python3 -c").otherwise(" ")
    script = F.when(k == 1, "custom/x/../s.py").when(k == 2, "../../out.py").when(k == 3, "/tmp/s.py").otherwise("")
    files = F.array(*map(F.lit, ("/vault/conf/p/python/main.py", "/vault/conf/p/python/config.template.json", "/vault/tools/py", "/vault/custom/s.py")))
    r = R.runtime(python, script, F.lit(""), F.lit("/vault"), F.lit("/vault/conf/p"), files, "main.py")
    return src.load(spark, d, "documents").select("doc_id", r["trust"].alias("trust"), F.coalesce(r["command"]["problem"], r["script"]["problem"], r["config"]["problem"]).alias("problem"), r["command"]["path"].alias("command"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'PREVIEW_LINE_INVALID' WHEN doc_id % 7 = 1 THEN 'PREVIEW_ENTRY_INVALID' WHEN doc_id % 7 = 2 THEN 'PREVIEW_PATH_MISSING' WHEN doc_id % 7 = 3 THEN 'WRITE_TARGET_TRAVERSAL' WHEN doc_id % 7 = 4 THEN 'PREVIEW_TARGET_MISSING' WHEN doc_id % 7 = 5 THEN 'PREVIEW_TARGET_NOT_FILE' ELSE 'OK' END AS code FROM documents""")
def preview_validation(spark, d):
    n, k = src.notes(spark, d), F.col("doc_id") % 7
    entry = lambda path: F.concat(F.lit('{"path":"'), path, F.lit('"}'))
    value = F.when(k == 0, "{broken").when(k == 1, "[1]").when(k == 2, '{"path":7}').when(k == 3, entry(F.concat(F.lit("../"), "relpath"))).when(k == 4, entry(F.concat(F.lit("gone/"), "relpath"))).otherwise(entry(F.col("relpath")))
    return W.preview_codes(n.select(F.col("doc_id").alias("seq"), value.alias("value")), n.select("relpath", (k != 5).alias("is_file"))).select(F.col("seq").alias("doc_id"), "code")


# ---- notes, tags, writes


@query(f"WITH {_NOTES}, {_STATE} SELECT n.relpath FROM notes n LEFT JOIN state s USING (relpath) WHERE sha1(n.body) IS DISTINCT FROM s.hash")
def dirty_filter(spark, d):
    n = src.notes(spark, d)
    return n.join(N.changed_notes(n, src.state(spark, d)).select("relpath"), "relpath", "left_semi").select("relpath")


@query(f"WITH {_CHUNKS} SELECT path, CAST(0 AS INTEGER) AS chunk, count(*) AS n FROM chunks GROUP BY path")
def vector_rebuild(spark, d):
    old = src.chunk_vectors(spark, d).where("false").select("path", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("n"))
    return N.upsert(old, src.chunk_vectors(spark, d).groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(0).alias("chunk"), "n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END AS tags FROM documents""")
def select_preview_updates(spark, d):
    k = F.col("doc_id")
    entry = F.from_json(F.to_json(F.struct(F.when(k % 2 == 1, F.col("source")).alias("summary"), F.when(k % 3 == 0, F.array(F.lit("a"))).alias("tags"))), W.UPDATES)
    u = W.preview_updates(entry)
    return src.load(spark, d, "documents").select("doc_id", u["summary"].alias("summary"), F.array_join(u["tags"], ",").alias("tags"))


@query(f"WITH {_TAGS}, x AS (SELECT note, i, CASE WHEN tag LIKE 'brand%' THEN tag END AS tag FROM once WHERE len(tag) >= 2 AND len(string_split(tag, '-')) <= 3) SELECT t.note, coalesce((SELECT string_agg(tag, ',' ORDER BY i) FROM x WHERE x.note = t.note), '') AS tags FROM tags t")
def filter_and_map_tags(spark, d):
    controlled = [f"brand{k}" for k in range(1, 100)]  # every brand is one of these
    return fuzzy.controlled_tags(_tags(spark, d), controlled, allow_free=False).select("note", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {_NOTES} SELECT relpath, sha1('---' || {NL} || 'title: x # kept' || {NL} || 'summary: new ' || doc_id || {NL} || 'tags:' || {NL} || '  - one' || {NL} || '  - ''2''' || {NL} || '---' || CASE WHEN starts_with(body, {NL}) THEN '' ELSE {NL} END || body) AS hash FROM notes""")
def update_frontmatter(spark, d):
    text = F.concat(F.lit("---\ntitle: x # kept\nsummary: old\n---\n"), "body")
    updates = F.struct(F.concat(F.lit("new "), _text("doc_id")).alias("summary"), F.array(F.lit("one"), F.lit("2")).alias("tags"))
    return src.notes(spark, d).select("relpath", F.sha1(Y.update_frontmatter(text, updates).cast("binary")).alias("hash"))


@query(f"""WITH {_NOTES} SELECT relpath, sha1('---' || {NL} || '{{tags: [' || CASE WHEN doc_id % 2 = 0 THEN 'x, ''a, b''' ELSE 'x' END || '], # mine' || {NL} || ' "summary": it''s ' || doc_id || ', n: {{k: [1, "}}"]}}' || CASE WHEN doc_id % 3 = 0 THEN ', concepts: []' ELSE '' END || '}}' || {NL} || '---' || {NL} || body) AS hash FROM notes""")
def update_flow_frontmatter(spark, d):
    n, k = src.notes(spark, d), F.col("doc_id")
    text = F.concat(F.lit('---\n{tags: [old, "]"], # mine\n "summary": \'o, {\', n: {k: [1, "}"]}}\n---\n'), "body")
    tags = F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("a, b"))).otherwise(F.array(F.lit("x")))
    updates = F.struct(F.concat(F.lit("it's "), k.cast("string")).alias("summary"), tags.alias("tags"), F.when(k % 3 == 0, F.array().cast("array<string>")).alias("concepts"))
    return n.select("relpath", F.sha1(Y.update_frontmatter(text, updates).cast("binary")).alias("hash"))


@query()
def parse_frontmatter(spark, d):
    text = F.concat(F.lit("---\nsummary: s\nn: "), _text("doc_id"), F.lit("\n---\n"), "body")
    return src.notes(spark, d).select("relpath", Y.parse_frontmatter(text).alias("data"))


def _plan(spark, d):
    links = select_links(spark, d).groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "kind"))), lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"))).alias("links"))
    updates = F.struct(F.lit("s").alias("summary"))
    return W.planned_writes(links.select(F.col("note").alias("relpath"), F.concat(F.lit("body of "), "note", F.lit("\n")).alias("text"), updates.alias("updates"), "links"))


_BLOCK = f"'body of ' || note || {NL} || {NL} || '---' || {NL} || {NL} || '{T.CALLOUT}' || {NL} || string_agg('> - <span class=\"{T.LINK_CLASS}' || kind || '\">[[' || path || '|' || split_part(path, '/', 2) || ']]</span>', {NL} ORDER BY pos) || {NL}"


@query(_links_sql(0.15, 0.25).replace("SELECT note, path, ['core'", f"SELECT note AS relpath, sha1('---' || {NL} || 'summary: s' || {NL} || '---' || {NL} || {_BLOCK}) AS hash, true AS changed FROM (SELECT note, path, ['core'") + ") GROUP BY note")
def note_write(spark, d):
    return _plan(spark, d).select("relpath", F.sha1(F.col("new_text").cast("binary")).alias("hash"), "changed")


@query(f"WITH {_CHUNKS} SELECT DISTINCT path AS relpath, sha1('body of ' || path || {NL} || {NL} || '---' || {NL}) AS hash FROM chunks")
def refresh_state_after_write(spark, d):
    paths = src.chunk_vectors(spark, d).select("path").distinct()
    links = F.array(F.struct(F.lit("a/b.md").alias("path"), F.lit("core").alias("kind")))
    plan = W.planned_writes(paths.select(F.col("path").alias("relpath"), F.concat(F.lit("body of "), "path", F.lit("\n")).alias("text"), F.struct(F.lit("s").alias("summary")).alias("updates"), links.alias("links")))
    return W.state_after(plan)


@query("""SELECT event_id, event_id % 4 = 0 OR event_id % 6 = 0 AS state_reloaded, event_id % 6 = 0 AS full_scan FROM events""")
def mtime_caches(spark, d):
    k = F.col("event_id")
    seen = lambda every: F.when(k % every == 0, F.lit(None).cast("long")).otherwise(k)
    state, config = ~k.eqNullSafe(seen(4)), ~k.eqNullSafe(seen(6))
    return src.load(spark, d, "events").select("event_id", (state | config).alias("state_reloaded"), config.alias("full_scan"))


# ---- the model client, without a server


@query(f"""WITH {_NOTES} SELECT relpath, 'Answer with one JSON object and nothing else. Keys: summary (one or two sentences), tags (up to 3), concepts (up to 4 noun phrases).' || {NL} || '- Tags: short broad themes of the note, kebab-case, one to three words each.' || {NL} || {NL} || 'Note:' || {NL} || substr(body, 1, len(body) - 1) AS prompt FROM notes""")
def build_prompt(spark, d):
    return src.notes(spark, d).select("relpath", M.prompt(F.col("body")).alias("prompt"))


@query()
def embed_chunks(spark, d):
    chunks = src.notes(spark, d).select(F.col("relpath").alias("path"), F.posexplode(T.chunks(F.col("body"))).alias("chunk", "text"))
    return M.embed_chunks(chunks, M.OfflineClient())


@query()
def extract_metadata(spark, d):
    return M.extract_metadata(src.notes(spark, d), M.OfflineClient()).select("relpath", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("concepts", ",").alias("concepts"), "error")


@query()
def tag_run(spark, d):
    n = src.notes(spark, d)
    return run.tag_notes(N.changed_notes(n, src.state(spark, d)), M.OfflineClient()).select("relpath", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("concepts", ",").alias("concepts"))


@query(f"WITH {_NOTES}, {_STATE} SELECT relpath FROM state EXCEPT SELECT relpath FROM notes")
def except_removed(spark, d):
    return src.state(spark, d).select("relpath").subtract(src.notes(spark, d).select("relpath"))
