"""Text functions as column expressions: normalising, tokens, keywords, plural stems, similarity of token sets."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never identify a subject.
STOP_WORDS = (
    "ola oi ei opa bom boa dia tarde noite gostaria quero queria preciso gostava poderia pode entender aprender saber "
    "conhecer ver falar fala explica explicar conta contar diga dizer me mais muito sobre como porque por que qual quais "
    "quando onde quem voce vc tem temos agora favor meu minha seu sua o a os as um uma uns umas de do da dos das no na nos "
    "nas e ou com sem para pra pro pelo pela em ao aos isso esse essa este esta isto funciona funcionamento modelo "
    "informacao informacoes recente recentes dados sim nao talvez ainda ja entao tambem"
).split()


def accent_pairs() -> tuple[str, str]:
    """Every Latin letter with marks (U+00C0 to U+024F) and the letter without them, derived from canonical decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if plain != chr(code) and len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def any_of(phrases) -> str:
    """A pattern that finds any of the phrases."""
    return "|".join(re.escape(p).replace("\\ ", " ") for p in phrases)


def begins_shared(phrases) -> str:
    """A pattern that finds whether there is any of the phrases: those with a beginning in common share its test."""

    def tail(rests: set[str]) -> str:
        if "" in rests:
            return ""  # a phrase ends here: longer ones add nothing
        heads = sorted({r[0] for r in rests})
        ways = [any_of([h]) + tail({r[1:] for r in rests if r[0] == h}) for h in heads]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?=[" + "".join(re.escape(h) for h in sorted({p[0] for p in phrases})) + "])" + tail(set(phrases))


def words_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_stop_word(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def without_accents(text: Column) -> Column:
    # texts of ASCII only, as long in bytes as in characters, have none
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *accent_pairs()))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(without_accents(text)))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the normalised text, in order, repeats kept."""
    return F.regexp_extract_all(normalised(text), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct tokens that are no stop words and are long enough or hold a digit."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: ~is_stop_word(t) & ((F.length(t) >= least) | t.rlike("[0-9]")))


def slug(title: Column, most: int = 40) -> Column:
    """A file name of a title: a-z and 0-9 of the normalised title, other runs as `_`. A longer one ends before the last
    `_` that fits, if that lies past the middle. `atomo` if nothing is left."""

    def cut(whole: Column) -> Column:
        head = F.substring(whole, 1, most + 1)
        last = F.length(F.regexp_extract(head, "^(.*)_", 1))  # what stands before the last `_`
        return F.when(F.length(whole) <= most, whole).when(F.contains(head, F.lit("_")) & (last > most // 2), F.substring(whole, F.lit(1), last)).otherwise(F.substring(whole, 1, most))

    whole = F.regexp_replace(F.regexp_replace(normalised(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(let(whole, cut), "^_+|_+$", ""), F.lit("")), F.lit("atomo"))


def heading(note: Column) -> Column:
    """The first line that begins with `## `, else the first line, without its number signs."""
    titled = F.regexp_extract(note, r"(?m)^[ \t]*(## .*)$", 1)
    first = F.regexp_extract(note, r"^([^\r\n]*)", 1)
    return F.trim(F.regexp_replace(F.when(titled != "", titled).otherwise(first), "^#+", ""))


def trimmed_query(text: Column, most: int = 6) -> Column:
    """The first words, in their own case, that are neither stop words nor single characters."""
    bare = lambda w: F.regexp_replace(normalised(w), r"[^\w]", "")
    kept = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(bare(w)) >= 2) & ~is_stop_word(bare(w)))
    return F.array_join(F.slice(kept, 1, most), " ")


def stem(token: Column) -> Column:
    """Plural stem of a token of normalised text: ordered suffix rules, short tokens untouched."""
    # The suffixes and their endings in place.
    t, n = token, F.length(token)

    def cut(k: int, end: str = "") -> Column:
        return F.concat(F.substring(t, F.lit(1), n - k), F.lit(end))

    return (
        F.when(n <= 3, t)
        .when(t.endswith("oes") & (n - 1 > 2), cut(3, "ao"))
        .when(t.endswith("aes") & (n - 1 > 2), cut(3, "ao"))
        .when(t.endswith("aos") & (n - 1 > 2), cut(3, "ao"))
        .when(t.endswith("ns") & (n - 1 > 2), cut(2, "m"))
        .when(t.endswith("is") & (n > 4), cut(2, "l"))
        .when(t.endswith("es") & (n > 4), cut(2))
        .when(t.endswith("s"), cut(1))
        .otherwise(t)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 when either is empty."""
    both, one = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / one)


def mentions(text: Column, keys: Column) -> Column:
    """Whether any key is a whole token of the text."""
    return F.arrays_overlap(tokens(text), keys)


def mentions_stem(text: Column, keys: Column) -> Column:
    """Like mentions, comparing plural stems."""
    return F.arrays_overlap(F.transform(tokens(text), stem), F.transform(keys, stem))


def han_share(text: Column) -> Column:
    """Share of Han and CJK-punctuation characters among those that aren't blank."""
    solid = F.regexp_replace(text, r"\s", "")
    # Fixed value: the ranges of Han characters and their punctuation.
    han = F.regexp_count(solid, F.lit("[　-〿㐀-䶿一-鿿豈-﫿]"))
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(han / F.length(solid))


def without_tag(text: Column, tag: str) -> Column:
    """Remove #tag as a whole word with the blanks before it, then blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"[ \t]*#{tag}\b", ""), r"[ \t]+\n", "\n")


def without_image_embeds(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[\[[^\]\n]*?\]\]", " ")
