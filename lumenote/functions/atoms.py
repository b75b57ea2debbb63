"""Notes as atoms: splitting, link lines, metadata, sections, repair and fusion verdicts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import ENGLISH, PORTUGUESE, english_title, function_words, hard_facts
from .text import han_share, keywords, normalised

# What a sentence is, and how one may end.
SENTENCE = "[^.!?;]+[.!?;]?"
ENDINGS = ".!?:;)”\"%"
# Least words of a body, of a repaired body, of a sentence whose language is told.
LEAST_BODY, LEAST_REPAIRED, LEAST_SENTENCE = 4, 5, 5


def first_by_key(items: Column, keys: Column) -> Column:
    """The items whose key, at the same place of `keys`, didn't occur before."""
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def atom_blocks(text: Column) -> Column:
    """Blocks that each begin with a `## ` line; what stands before the first is left out."""
    marked = F.regexp_replace(text, r"(?m)^(?=[ \t]*## )", "\u0001")
    blocks = F.filter(F.split(marked, "\u0001"), lambda b, i: i > 0)
    return F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def links_line(content: Column) -> Column:
    """Link targets of a line whatever its brackets: `[[A]] [[B]]`, names of 60 characters at most, one per spelling."""
    groups = F.regexp_extract_all(content, F.lit(r"\[+([^\[\]]+)\]+"), F.lit(1))
    groups = F.when(F.size(groups) == 0, F.array(content)).otherwise(groups)
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"\([^)]*\)", ""), r"(?i)\s*(?:,|;|\bou\b)\s*")))
    names = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ .*\[\]\s]+|[ .*\[\]\s]+$", "")), lambda p: (p != "") & (F.length(p) <= 60))
    return F.array_join(F.transform(first_by_key(names, F.transform(names, F.lower)), lambda p: F.concat(F.lit("[["), p, F.lit("]]"))), " ")


def unwrapped(line: Column) -> Column:
    """A phrase in angle brackets without them; a single word in them is markup and stays."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    whole = r"""(?s)^<(.+)>([.,;:!?*"']*)$"""
    inner = F.regexp_extract(s, whole, 1)
    cut_short = s.startswith("<") & ~F.contains(s, F.lit(">")) & F.contains(s, F.lit(" "))
    return F.when(s.rlike(whole) & F.contains(inner, F.lit(" ")), F.concat(inner, F.regexp_extract(s, whole, 2))).when(cut_short, F.substring(s, F.lit(2), F.length(s))).otherwise(line)


def sections(text: Column) -> Column:
    """Sections at headers of level 1 to 3, each a struct of its path (titles joined by ` > `) and its text with header."""
    marked = F.filter(F.split(F.regexp_replace(text, r"(?m)^(?=#{1,3} )", "\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    start = F.struct(F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit("").alias("h3"), F.array().cast("array<struct<path:string,text:string>>").alias("out"))

    def step(a, s):
        level = F.length(F.regexp_extract(s, "^(#{1,3}) ", 1))
        title = F.trim(F.regexp_extract(s, r"^#{1,3} ([^\n]*)", 1))
        h1 = F.when(level == 1, title).otherwise(a["h1"])
        h2 = F.when(level == 2, title).when(level == 1, F.lit("")).otherwise(a["h2"])
        h3 = F.when(level == 3, title).when(level.isin(1, 2), F.lit("")).otherwise(a["h3"])
        path = F.array_join(F.filter(F.array(h1, h2, h3), lambda h: h != ""), " > ")
        return F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), F.concat(a["out"], F.array(F.struct(path.alias("path"), s.alias("text")))).alias("out"))

    return F.aggregate(marked, start, step, lambda a: a["out"])


def note_metadata(path: Column, origin: Column, collected: Column, text: Column, new_folder: str, figures: str) -> list[Column]:
    """Trust, source kind, collection time, note kind and flags of a note; an absent value is null."""
    fresh = F.contains(path, F.lit(new_folder))
    has_origin = F.coalesce(origin, F.lit("")) != ""
    kind = F.when(F.exists(F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1), lambda p: p == figures.lower()), "figura").otherwise("texto")
    return [
        F.when(fresh, "Web").when(has_origin, "Conversa").otherwise("Local").alias("origin"),
        F.when(fresh, 0.6).when(has_origin, 0.8).otherwise(1.0).alias("confidence"),
        F.try_to_date(collected, "yyyy-MM-dd").alias("collected"),
        kind.alias("kind"),
        ((kind == "figura") & F.contains(text, F.lit("#figura_anexo"))).alias("attach_only"),
    ]


def source_label(score: Column, sibling: Column, kind: Column, confidence: Column) -> Column:
    """What a passage of the context is, to be put before it."""
    return (
        F.when(score.isNull() & sibling, "[Mesma página - completa o trecho que respondeu] ")
        .when(score.isNull(), "[Malha - relacionado] ")
        .when(kind == "figura", "[Figura do acervo — a imagem já é mostrada ao usuário; descreva o que ela ensina, NÃO repita o link] ")
        .otherwise(F.concat(F.lit("[Local - Confiança: "), confidence.cast("string"), F.lit("] ")))
    )


def english_sentences(body: Column) -> Column:
    """Sentences of five words or more with two English function words or more, and more English than Portuguese ones."""
    words = lambda s: F.size(F.regexp_extract_all(F.lower(s), F.lit("[a-zà-ÿ]+"), F.lit(0)))

    def english(s):
        en = function_words(s, ENGLISH)
        return (words(s) >= LEAST_SENTENCE) & (en >= 2) & (en > function_words(s, PORTUGUESE))

    return F.transform(F.filter(F.regexp_extract_all(body, F.lit(SENTENCE), F.lit(0)), english), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def mainly_portuguese(text: Column) -> Column:
    """Neither mostly English as a whole nor with a sentence that is English or has no Portuguese function word."""
    words = lambda s: F.size(F.regexp_extract_all(F.lower(s), F.lit("[a-zà-ÿ]+"), F.lit(0)))

    def foreign(s):
        en, pt = function_words(s, ENGLISH), function_words(s, PORTUGUESE)
        return (words(s) >= LEAST_SENTENCE) & ((pt == 0) | ((en >= 2) & (en > pt)))

    en = function_words(text, ENGLISH)
    return ~((en >= 2) & (en > function_words(text, PORTUGUESE))) & ~F.exists(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), foreign)


def content_words(text: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.size(F.array_distinct(F.filter(F.split(normalised(text), r"\s+"), lambda w: F.length(w) > 2)))


def ends_well(text: Column) -> Column:
    return F.contains(F.lit(ENDINGS), F.right(text, F.lit(1))) & (F.length(text) > 0)


def atom_state(title: Column, body: Column) -> Column:
    """Triage of a stored atom: figure, empty, truncated, language, ok."""
    s = F.regexp_replace(body, r"^\s+|\s+$", "")
    return (
        F.when(F.contains(s, F.lit("![[")) | F.lower(F.trim(title)).startswith("figura"), "figura")
        .when(content_words(s) < LEAST_BODY, "vazio")
        .when(~ends_well(s), "truncado")
        .when(F.size(english_sentences(s)) > 0, "idioma")
        .otherwise("ok")
    )


def refusal(new: Column, old: Column) -> Column:
    """Why a repaired body may not take the old one's place, null if it may; the first rule that holds."""
    bare = F.regexp_replace(normalised(new), r"^[.!?]+|[.!?]+$", "")
    return (
        F.when(F.coalesce(new, F.lit("")) == "", "vazia")
        .when(bare == "nada", "nada")
        .when(content_words(new) < LEAST_REPAIRED, "curta")
        .when(han_share(new) > 0.15, "cjk")
        .when(english_title(new), "ingles")
        .when(~mainly_portuguese(new), "misto")
        .when(~ends_well(F.regexp_replace(new, r"\s+$", "")), "truncada")
        .when(F.trim(new) == F.trim(old), "igual")
    )


def worth_adding(old: Column, new: Column, least_words: int = 4) -> Column:
    """Whether an old atom adds to its new counterpart: hard facts it alone has, or enough content words."""
    facts = F.array_except(hard_facts(old), hard_facts(new))
    words = F.filter(F.array_except(keywords(old), keywords(new)), lambda w: F.length(w) >= 4)
    return F.when(new.isNull(), "sem par").when(F.size(facts) > 0, "dado").when(F.size(words) >= least_words, "palavras").otherwise("coberto")


def origin_domain(origin: Column) -> Column:
    """The work of a page's origin, else the origin itself as a bucket."""
    o = F.trim(F.coalesce(origin, F.lit("")))
    work = F.regexp_extract(o, "'([^']+)'", 1)
    return F.when(o == "", "").when(o.rlike(r"\(p\.\s*\d+") & (work != ""), F.concat(F.lit("obra:"), normalised(work))).otherwise(F.concat(F.lit("balde:"), normalised(o)))


# How tags and link lines are written in notes, and the tags that every new atom has.
TAG, TAG_LINE, TAGS_AT_END = r"#[\w/\-]+", r"(?U)^\s*#[\w/\-]+(\s+#[\w/\-]+)*\s*$", r"(?U)(\s+#[\w/\-]+)+\s*$"
LINKS, LINKS_LINE = "**Malha Neural:**", r"(?i)^\s*(?:\*\*Malha Neural:\*\*\s*(?=(.*)$)|\*\*[^*\n]{2,40}:\*\*\s*(?=(.*\[.*)$)).*$"
ATOM_TAGS = ("#zettelkasten_atomico", "#conhecimento_novo")


def normal_atoms(df: DataFrame, block: Column, origin: Column, day: Column, tags: tuple[str, ...] = ATOM_TAGS) -> DataFrame:
    """Adds atom: the block in the form of a stored atom (header, title, body, tags), empty if there is nothing to store.

    Lines lose angle brackets; tags are gathered from lines of their own and line ends; link lines are rewritten. The
    first other line is the title if it is a header or short and open-ended; without one the first six words are. A body
    of `nada`, mostly Han, or none under a real header is nothing.
    """
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    col = F.col
    # step by step, so that no part is written into the next more than once
    out = df.withColumn("_bare", strip(F.regexp_replace(strip(block), r"^---\n(?:[^\n]*\n)*?---\n?", "")))
    out = out.withColumn("_raw", F.transform(F.split("_bare", r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", "")))
    out = out.withColumn("_lines", F.transform("_raw", unwrapped))
    ends = F.transform("_lines", lambda x: F.when(x.rlike(TAG_LINE), x).otherwise(F.coalesce(F.regexp_substr(x, F.lit(TAGS_AT_END)), F.lit(""))))
    out = out.withColumn("_tags", F.array_distinct(F.concat(F.regexp_extract_all(F.array_join(ends, " "), F.lit("(?U)" + TAG), F.lit(0)), F.array(*(F.lit(t) for t in tags)))))
    # a line that held only tags is gone, an empty one stays
    out = out.withColumn("_cut", F.transform("_lines", lambda x: F.when(x.rlike(TAG_LINE), None).otherwise(F.regexp_replace(F.regexp_replace(x, TAGS_AT_END, ""), r"\s+$", ""))))
    out = out.withColumn("_rest", F.filter("_cut", lambda x, i: x.isNotNull() & ((x != "") | (F.get(col("_lines"), i) == ""))))
    content = lambda x: strip(F.concat(F.regexp_extract(x, LINKS_LINE, 1), F.regexp_extract(x, LINKS_LINE, 2)))
    out = out.withColumn("_linked", F.transform("_rest", lambda x: x.rlike(LINKS_LINE)))
    out = out.withColumn("_content", F.transform("_rest", lambda x, i: F.when(F.get(col("_linked"), i), content(x))))
    out = out.withColumn("_links", F.transform("_content", lambda x: F.when(x.isNotNull(), links_line(x))))
    # the first line that is neither tags nor links
    out = out.withColumn("_place", F.array_position("_linked", False))
    out = out.withColumn("_first", F.when(col("_place") > 0, F.get(col("_rest"), (col("_place") - 1).cast("int"))).otherwise(""))
    out = out.withColumn("_header", F.ltrim("_first").startswith("#"))
    short = (F.trim("_first") != "") & (F.length(F.trim("_first")) <= 80) & ~F.trim("_first").rlike("[.!?:;,]$")
    out = out.withColumn("_title", F.when(col("_header"), strip(F.regexp_replace("_first", "^#+", ""))).when(short, strip(col("_first"))))
    words = F.transform("_rest", lambda x, i: F.when(col("_title").isNotNull() & (i + 1 == col("_place")), None).when(F.get(col("_linked"), i), F.when(F.get(col("_links"), i) != "", F.concat(F.lit(LINKS + " "), F.get(col("_links"), i)))).otherwise(x))
    out = out.withColumn("_kept", words)
    out = out.withColumn("_body", strip(F.array_join("_kept", "\n")))
    out = out.withColumn("_plain", strip(F.array_join(F.filter("_kept", lambda x, i: ~F.get(col("_linked"), i)), "\n")))
    nothing = (F.regexp_replace(normalised(col("_plain")), "^[.!?]+|[.!?]+$", "") == "nada") | ((col("_plain") == "") & col("_header")) | (han_share(col("_plain")) > 0.15)
    six = F.array_join(F.slice(F.filter(F.split("_body", r"\s+"), lambda w: w != ""), 1, 6), " ")
    name = F.coalesce(F.nullif("_title", F.lit("")), F.nullif(six, F.lit("")), F.lit("Atomo"))
    parts = [F.lit("---"), F.concat(F.lit("origem: "), origin), F.concat(F.lit("colhido_em: "), day), F.lit("---"), F.concat(F.lit("## "), name), F.nullif("_body", F.lit("")), F.array_join("_tags", " ")]
    atom = F.when((col("_bare") == "") | nothing, "").otherwise(F.concat(F.concat_ws("\n", *parts), F.lit("\n")))
    return out.withColumn("atom", atom).select(*df.columns, "atom")


def corrected_target(target: Column, folder: str = "Figuras") -> Column:
    """The target of a flat figure link with the folder that its file name tells; null where nothing is to be done."""
    # Fixed value: how figure files are named, after the book, its page and the figure.
    named = rf"^{folder}/([^/\n]+)_p[0-9]{{4}}_f[0-9]+\.webp$"
    clean = F.regexp_replace(target, r"^\s+|\s+$", "")
    return F.when(clean.rlike(named), F.concat(F.lit(f"{folder}/"), F.regexp_extract(clean, named, 1), F.substring(clean, F.lit(len(folder) + 1), F.length(clean))))


def rewritten_embeds(text: Column, old: str, new: str) -> Column:
    """text and n: a prefix of link targets replaced inside `[[...]]` only, and how many were."""
    inside = rf"(?<!\[)\[\[(?:{re.escape(old)})"
    return F.struct(F.regexp_replace(text, inside, "[[" + new.replace("\\", "\\\\").replace("$", "\\$")).alias("text"), F.regexp_count(text, F.lit(inside)).alias("n"))


def broken_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """The links whose target is a path (has a slash) to a file that moved; links by name still find theirs."""
    path = F.regexp_replace(F.replace("target", F.lit("\\"), F.lit("/")), "^[./]+", "")
    return links.filter(F.contains("target", F.lit("/"))).join(moved.select(F.col("path").alias("_moved")).distinct(), path == F.col("_moved"), "left_semi")
