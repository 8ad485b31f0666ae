"""What a run would write: new texts of notes, checks of preview rows, and the state after a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.frontmatter import update_frontmatter
from notefold.functions.text import SECTION_HEADING, body_signature, diagnostic_line, render_links, strip_frontmatter, strip_sections, strip_trailing_dividers, target_code
from notefold.sources.vault import registered

UPDATES = "summary string, tags array<string>, concepts array<string>, related array<string>"


def preview_updates(entry: Column) -> Column:
    """summary, tags, concepts and related of a preview entry; what is absent is empty."""
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(entry["summary"], F.lit("")).alias("summary"), *[F.coalesce(entry[k], none).alias(k) for k in ("tags", "concepts", "related")])


def preview_codes(lines: DataFrame, listed: DataFrame, root: str | None = None) -> DataFrame:
    """seq, path, code of preview lines (seq, value) that are not blank; listed: (relpath, is_file) of what exists.

    code is OK or what is wrong: PREVIEW_LINE_INVALID, PREVIEW_ENTRY_INVALID,
    PREVIEW_PATH_MISSING, a code of target_code, PREVIEW_TARGET_MISSING or
    PREVIEW_TARGET_NOT_FILE.
    """
    v = F.try_parse_json("value")
    path = F.try_variant_get(v, "$.path", "string")
    named = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.path", "variant")) == "STRING", F.lit(False)) & (F.trim(path) != "")
    own = lines.where(F.trim("value") != "").select("seq", F.when(named, path).alias("path"), v.isNull().alias("broken"), F.startswith(F.schema_of_variant(v), F.lit("OBJECT")).alias("object"))
    known = listed.select(F.col("relpath").alias("path"), F.col("is_file"))
    target = target_code(F.col("path"), root)
    code = (
        F.when(F.col("broken"), "PREVIEW_LINE_INVALID").when(~F.col("object"), "PREVIEW_ENTRY_INVALID").when(F.col("path").isNull(), "PREVIEW_PATH_MISSING").when(target != "OK", target)
        .when(F.col("is_file").isNull(), "PREVIEW_TARGET_MISSING").when(~F.col("is_file"), "PREVIEW_TARGET_NOT_FILE").otherwise("OK")
    )
    return own.join(known, "path", "left").select("seq", "path", code.alias("code"))


def with_links(text: Column, links: Column, headings: tuple[str, ...] = (SECTION_HEADING,)) -> Column:
    """text with its generated section replaced by one of links (path, kind); without links it goes."""
    clean = strip_sections(text, list(headings))
    block = render_links(links)
    return F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.concat(F.rtrim(strip_trailing_dividers(clean)), F.lit("\n\n---\n\n"), block, F.lit("\n"))).otherwise(clean)


def planned_writes(notes: DataFrame, section: bool = True, headings: tuple[str, ...] = (SECTION_HEADING,)) -> DataFrame:
    """relpath, new_text, changed of notes (relpath, text, updates, links). A note whose front matter is no mapping has a null new_text, unchanged."""
    new = update_frontmatter(F.col("text"), F.col("updates"))
    if section:
        new = F.when(new.isNotNull(), with_links(new, F.col("links"), headings))
    return notes.select("relpath", "text", new.alias("new_text")).select("relpath", "new_text", (F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))).alias("changed"))


def state_after(written: DataFrame, headings: tuple[str, ...] = (SECTION_HEADING,)) -> DataFrame:
    """(relpath, hash) of written notes (relpath, new_text): the body as the next scan reads it."""
    return written.select("relpath", body_signature(strip_sections(strip_frontmatter(F.col("new_text")), list(headings))).alias("hash"))


def apply_writes(plan: DataFrame, root: str) -> DataFrame:
    """Write the changed notes of a plan under root, a folder that all executors share; relpath, written.

    Tasks stage the files and the driver moves them once all are there, so a
    task that fails leaves every note as it was.
    """
    safe = plan.where("changed").where(target_code(F.col("relpath")) == "OK")
    registered(plan.sparkSession)
    safe.select("relpath", F.col("new_text").cast("binary").alias("content")).write.format("notes").mode("append").save(root)
    return safe.select("relpath", F.lit(True).alias("written"))


# What is told about a refused preview entry, by code: message and guidance.
REFUSALS = {
    "PREVIEW_LINE_INVALID": ("This line of the preview is not JSON.", "Write the preview again."),
    "PREVIEW_ENTRY_INVALID": ("This line of the preview is no JSON object.", "Each line has to be an object that names a path."),
    "PREVIEW_PATH_MISSING": ("This entry names no path.", "Write the preview again so that every entry names its note."),
    "WRITE_TARGET_EMPTY": ("This entry names no note to write.", "Write the preview again so that every entry names its note."),
    "WRITE_TARGET_TRAVERSAL": ("This path climbs out of its folder.", "Name notes by paths below the vault."),
    "WRITE_TARGET_OUTSIDE_VAULT": ("This path lies outside of the vault.", "Name notes by paths below the vault."),
    "WRITE_TARGET_NOT_MARKDOWN": ("This path is no markdown file.", "Only markdown notes are written."),
    "PREVIEW_TARGET_MISSING": ("The note of this entry is not there.", "Drop the entry, or write the preview again."),
    "PREVIEW_TARGET_NOT_FILE": ("The path of this entry is no file.", "Name a note and not a folder."),
}


def refusal_lines(codes: DataFrame) -> DataFrame:
    """(value) a diagnostic line for each refused entry (seq, path, code), with guidance and where it stands."""
    message, guidance = (F.element_at(F.create_map(*(F.lit(x) for k, v in REFUSALS.items() for x in (k, v[at]))), F.col("code")) for at in (0, 1))
    context = F.when(F.col("path").isNull(), F.create_map(F.lit("entry"), F.col("seq").cast("string"))).otherwise(F.create_map(F.lit("entry"), F.col("seq").cast("string"), F.lit("path"), F.col("path")))
    return codes.where("code <> 'OK'").select(diagnostic_line(F.lit("warn"), F.col("code"), message, context, guidance).alias("value"))
