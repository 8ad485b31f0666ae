"""Column functions on note texts, paths, tags and lists; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How generated sections are written in notes.
SECTION_HEADING = "## Mindmap"
SECTION_MARKS = "mindmap:(start|end)"
CALLOUT = "> [!mindmap]- Mindmap"
CALLOUT_PATTERN = r">[^\S\n]*\[![^\n]*\]-[^\S\n]*(?:mindmap|related)"
OLD_HEADINGS = ("## related", "## mindmap")
LINK_CLASS = "mindmap-link is-"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")  # a run within the text is read once


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def body_signature(body: Column) -> Column:
    return F.sha1(body.cast("binary"))


def window_sizes(target_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """Words in a chunk and words that chunks share, from token counts at three words in four tokens."""
    size, shared = max(50, int(target_tokens * 0.75)), max(10, int(overlap_tokens * 0.75))
    if shared >= size:
        raise ValueError("chunks must advance: the overlap has to be smaller than the target")
    return size, shared


def chunks(text: Column, target_tokens: int = 300, overlap_tokens: int = 40) -> Column:
    """Overlapping windows of words; the last ends with the text. No words: no chunks."""
    size, shared = window_sizes(target_tokens, overlap_tokens)
    step = size - shared

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    # the words are a variable of a function here, so a text is split once, not for each chunk
    return F.flatten(F.transform(F.array(words(text)), cut))


def title_of(path: Column) -> Column:
    """File stem: only the last suffix goes, and a leading dot stays."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def top_folder(path: Column) -> Column:
    """What stands before the first slash; the whole name of a file at the root."""
    return F.substring_index(path, "/", 1)


def normalize_folder(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/++|(?<!/)/++$", "")


def in_folder(path: Column, folder: Column) -> Column:
    return (folder == ".") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def normalize_tag(tag: Column) -> Column:
    kept = F.regexp_replace(F.lower(strip(tag)), r"(?U)[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "-"), "-+", "-"), "^-|-$", "")


def normalize_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != ""))


def split_list_field(value: Column) -> Column:
    """Items of a string-valued list field. The class holds a backslash, the letter n, comma and semicolon, as callers rely on."""
    return F.filter(F.transform(F.split(value, r"[\\n,;]+"), strip), lambda x: x != "")


def keep_first_ignoring_case(items: Column) -> Column:
    """Items that are not null, once each whatever their case, in order: sorted by name and place, the first of each name, back in order."""
    named = F.array_sort(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x, i: F.struct(F.lower(x).alias("name"), i.alias("place"), x.alias("item"))))
    # the sorted list is a variable of a function here, so it is made once, not for each item
    firsts = F.transform(F.array(named), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["name"] != x["name"])))
    back = F.array_sort(F.transform(F.flatten(firsts), lambda x: F.struct(x["place"].alias("place"), x["item"].alias("item"))))
    return F.transform(back, lambda x: x["item"])


def title_case(text: Column) -> Column:
    """Every run of letters with its first in upper case and the others in lower case, wherever it stands: It'S E-Mail."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def normalize_concepts(items: Column, max_words: int = 4, limit: int = 4, case: str = "lower") -> Column:
    """Items that are not empty or too long, once each whatever their case, in order, up to limit (0: all). case: lower, title or keep."""
    shown = {"lower": F.lower, "title": title_case, "keep": lambda x: x}[case]
    kept = F.filter(F.transform(items, strip), lambda x: (x != "") & (F.lit(not max_words) | (word_count(x) <= max_words)))
    kept = keep_first_ignoring_case(F.transform(kept, lambda x: shown(x)))
    return F.slice(kept, 1, limit) if limit else kept


def allowed_tags(tags: Column, min_length: int = 2, max_words: int = 3) -> Column:
    """Tags long enough and of few enough hyphenated words, in order, once each."""
    return F.array_distinct(F.filter(tags, lambda t: (F.length(t) >= min_length) & (F.size(F.split(t, "-")) <= max_words)))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def frontmatter_end(text: Column) -> Column:
    """Number of the line (from 1) that closes the front matter; 0 without any."""
    rest = F.transform(F.slice(lines(text), 2, 1_000_000_000), strip)
    at = F.array_position(rest, "---").cast("int")
    return F.when(F.startswith(text, F.lit("---")) & (at > 0), at + 1).otherwise(0)


def strip_frontmatter(text: Column) -> Column:
    end = frontmatter_end(text)
    return F.when(end > 0, F.array_join(F.slice(lines(text), end + 1, 1_000_000_000), "\n")).otherwise(text)


def strip_trailing_dividers(text: Column) -> Column:
    """Text up to its last line that is neither blank nor a divider."""
    own = lines(text)
    kept = F.transform(own, lambda x, i: F.when(~strip(x).isin("", "---"), i + 1).otherwise(0))
    return F.array_join(F.slice(own, 1, F.array_max(kept)), "\n")


def strip_sections(text: Column, headings: list[str]) -> Column:
    """Text without generated sections: lines with a section marker, sections under the headings or the old ones, folded callouts; stripped, with a newline.

    Each kind goes in one pass: a section lasts to the next line with a # at its start, a callout to the next line without a >.
    """
    low = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in h) for h in dict.fromkeys([*(h.strip().lower() for h in headings), *OLD_HEADINGS]))
    blank, rest = r"[^\S\n]*", r"(?s:.)*?"
    own = F.regexp_replace(text, "\r\n?", "\n")
    own = F.regexp_replace(own, rf"(?dmi)^[^\n]*{SECTION_MARKS}[^\n]*(?:\n|\z)", "")
    own = F.regexp_replace(own, rf"(?dmiUu)^{blank}(?:{low}){blank}$" + rest + r"(?=\n#|\z)\n?", "")
    own = F.regexp_replace(own, rf"(?dmiUu)^{blank}{CALLOUT_PATTERN}{blank}$" + rest + r"(?=\n(?!>)|\z)\n?", "")
    return F.concat(strip(own), F.lit("\n"))


def render_links(links: Column, heading: str = CALLOUT) -> Column:
    """A callout with a line for each link (path, kind; none: core); paths that are null or empty are left out. No links: empty."""
    shown = F.filter(links, lambda l: F.coalesce(l["path"], F.lit("")) != "")
    row = lambda l: F.concat(F.lit(f'\n> - <span class="{LINK_CLASS}'), F.coalesce(l["kind"], F.lit("core")), F.lit('">[['), l["path"], F.lit("|"), title_of(l["path"]), F.lit("]]</span>"))
    return F.when(F.size(links) > 0, F.concat(F.lit(heading), F.array_join(F.transform(shown, row), ""))).otherwise("")


def salvaged_json(content: Column) -> Column:
    """The content if it is JSON, else what lies from its first brace to its last if that is, else null."""
    inner = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(content), content).when((inner != "") & ok(inner), inner)


def lexical(path: Column) -> Column:
    """An absolute path without empty, '.' and '..' parts; climbing past the root stays there."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path: Column, root: Column) -> Column:
    return (path == root) | (root == "/") | F.startswith(path, F.concat(root, F.lit("/")))


def target_code(target: Column, root: str | None = None) -> Column:
    """What is wrong with a write target, or OK. Relative ones must not climb; absolute ones must lie in root, and none does without a root.

    A name that is nothing but the suffix is no markdown file.
    """
    own = strip(target)
    absolute, parts = F.startswith(own, F.lit("/")), F.split(F.replace(own, F.lit("\\"), F.lit("/")), "/")
    within = inside(lexical(own), lexical(F.lit(root))) if root is not None else F.lit(False)
    return (
        F.when(F.coalesce(own, F.lit("")) == "", "WRITE_TARGET_EMPTY").when(~absolute & F.array_contains(parts, ".."), "WRITE_TARGET_TRAVERSAL")
        .when(absolute & ~within, "WRITE_TARGET_OUTSIDE_VAULT").when(~lexical(F.concat(F.lit("/"), own)).rlike(r"(?i)[^/]\.md$"), "WRITE_TARGET_NOT_MARKDOWN").otherwise("OK")
    )


def diagnostic_line(level: Column, code: Column, message: Column, context: Column, guidance: Column | None = None) -> Column:
    """[level][code] message, with guidance and the context map's entries after it if there are any."""
    pairs = F.array_join(F.transform(F.map_entries(context), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.concat(F.lit("["), level, F.lit("]["), code, F.lit("] "), message, F.coalesce(F.concat(F.lit(" Guidance: "), F.nullif(guidance, F.lit(""))), F.lit("")) if guidance is not None else F.lit(""), F.when(F.size(context) > 0, F.concat(F.lit(" Context: "), pairs)).otherwise(""))
