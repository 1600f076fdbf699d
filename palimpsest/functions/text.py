"""Column expressions on text: URLs, white space, wiki markup that is regular, HTML, section titles, word lists.

All are built-in functions, so filters over them stay in the JVM. Classes of white space are spelled out, as \\s means
different sets in different engines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL pattern (it ends at white space, a pipe or a closing bracket), its stand-in, suffixes of bare sites.
URL = r"https?://[^\s|\]]+"
URL_TOKEN = "URL"
BARE_SUFFIXES = (".com", ".uk", ".org", ".ca", ".au", ".nz", ".net")
VIDEO_SITE = "youtube.com"
#: Comment markers of tools and reverts.
COMMENT_BLOCKLIST = ("[[Project:AWB|AWB]]", "[[Project:AutoWikiBrowser|AWB]]", "Undid revision")
DIFF_BASE = "https://en.wikipedia.org/w/index.php?title="
#: A word, or one character that is neither part of a word nor white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts occurs in the text."""
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def links(html: Column) -> Column:
    """The targets of href attributes in double quotes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def without_urls(text: Column, replacement: str = URL_TOKEN) -> Column:
    return F.regexp_replace(text, URL, replacement)


def clean_newlines(text: Column) -> Column:
    """Runs of line ends become one \\n, runs of tabs, spaces and no-break spaces one space; trimmed at both ends."""
    spaced = F.regexp_replace(F.regexp_replace(text, "[\r\n]+", "\n"), "[\t  ]+", " ")
    return F.btrim(spaced, F.lit(" \t\n\r\x0b\x0c"))


def compress_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def canonical_url(url: Column) -> Column:
    """Lower case; no scheme, www., default port, fragment or final slash; query parameters in order."""
    low = F.lower(F.trim(url))
    bare = F.regexp_replace(F.regexp_replace(low, "#.*$", ""), r"^[a-z][a-z0-9+.-]*://(www[0-9]*\.)?", "")
    path = F.regexp_replace(F.regexp_replace(F.split_part(bare, F.lit("?"), F.lit(1)), r"^([^/:]+):(80|443)(/|$)", "$1$3"), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def valid_url(url: Column) -> Column:
    """Not a bare site (by its suffix) and not a video."""
    return ~(any_of([F.endswith(url, F.lit(s)) for s in BARE_SUFFIXES]) | F.contains(url, F.lit(VIDEO_SITE)))


def whitelisted(url: Column, domains: Sequence[str]) -> Column:
    """Whether a listed domain occurs anywhere in the URL (a substring, not the host)."""
    return contains_any(url, domains)


def host_whitelisted(url: Column, domains: Sequence[str]) -> Column:
    """Whether the URL's host is a listed domain or below one."""
    return any_of([(host(url) == d) | F.endswith(host(url), F.lit("." + d)) for d in domains])


def section_title(comment: Column) -> Column:
    """Struct of title and rest of an edit comment that starts with /* title */; title '' if it doesn't."""
    found = r"^/\*([^\n]+)\*/([^\n]*)\n?\z"
    titled = F.regexp_like(comment, F.lit(found))
    return F.struct(
        F.when(titled, F.trim(F.regexp_extract(comment, found, 1))).otherwise("").alias("title"),
        F.when(titled, F.trim(unescape(F.trim(F.regexp_extract(comment, found, 2))))).otherwise(comment).alias("rest"),
    )


def unescape(text: Column) -> Column:
    """The five entities of XML and the no-break space; functions.python.unescape_html knows all."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def diff_url(title: Column, rev_id: Column, parent_id: Column) -> Column:
    return F.concat(F.lit(DIFF_BASE), F.replace(title, F.lit(" "), F.lit("%20")), F.lit("&type=revision&diff="), rev_id, F.lit("&oldid="), parent_id)


#: What goes as markup.
MARKUP = (r"(?s)<table.*>.*</table>", r"<!--[^<>]*-->", r"<\w+>[^<>]*</\w+>", r"<\w+>|<\w+/>", r"\{\{[^{}]*\}\}", "&nbsp;")
#: Fixed value: a reference.
REFERENCE = r"<ref[^<>]*/>|<ref[^<>]*>[^<>]*</ref>|\{\{sfn\|[^{}]*\}\}"


def clean_wikitext(text: Column) -> Column:
    """Labels of piped links; no link brackets, bold marks, tables, comments, paired or single tags, flat templates.

    Each kind of markup goes in one pass, in the order of MARKUP: what a pass leaves isn't looked at again by it.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\[\]]+\|([^\[\]]+)\]\]", "$1"), r"\[\[|\]\]", "")
    return F.btrim(reduce(lambda t, pattern: F.regexp_replace(t, pattern, ""), ("''", *MARKUP), bare), F.lit("\n"))


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))


def without_references(text: Column) -> Column:
    return F.regexp_replace(text, REFERENCE, "")


HEADING = r"(?m)^(=+)[^=\n]+?\1[ \t]*$"


def sections(text: Column) -> Column:
    """Array of (title, text) in order; what comes before the first heading is called Lead."""
    titles = F.concat(F.array(F.lit("Lead")), F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)), lambda h: F.btrim(h, F.lit("= \t"))))
    return F.zip_with(titles, F.transform(F.split(text, HEADING), lambda t: F.btrim(t, F.lit("\n "))), lambda a, b: F.struct(a.alias("title"), b.alias("text")))


def html_to_text(html: Column) -> Column:
    """All text outside script and style, entities resolved, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(text), "[ \t\r\n ]+", " "))


def main_article(html: Column) -> Column:
    """Text of the <article> element if there is one, else of the page without navigation, aside, header, footer and forms."""
    inner = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    outer = F.regexp_replace(html, r"(?is)<(nav|aside|header|footer|form)[^>]*>.*?</(nav|aside|header|footer|form)>", " ")
    return html_to_text(F.when(inner != "", inner).otherwise(outer))


def tokens(text: Column) -> Column:
    """Words and single other characters, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def space_words(text: Column) -> Column:
    """Parts of the text between white space; none in an empty text."""
    return F.filter(F.split(text, "[ \t\r\n\x0b\x0c]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences: they end at . ! or ? (and closing quotes or brackets) before white space and a capital, digit or quote."""
    parts = F.split(text, "(?<=[.!?][\"')\\]]{0,2})[ \t\r\n]+(?=[\"'(\\[]?[\\p{Lu}\\p{N}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def last_sentences(text: Column, k: int = 3) -> Column:
    found = sentences(text)
    return F.array_join(F.when(F.size(found) <= k, found).otherwise(F.slice(found, -k, k)), " ")


def clean_sentence(text: Column) -> Column:
    """No brackets; at line ends inside a word, parts without a letter, digit or quote go."""
    tokens_ = F.split(F.translate(text, "[]", ""), " ")

    def cleaned(token: Column) -> Column:
        parts = F.split(token, "\n")
        kept = F.when(F.size(parts) > 1, F.filter(parts, lambda p: F.regexp_like(p, F.lit("[a-zA-Z0-9']")))).otherwise(parts)
        return F.trim(F.array_join(kept, " "))

    return F.trim(F.array_join(F.transform(tokens_, cleaned), " "))


#: Frequent words of a few languages, to tell them apart.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces ses été elle être".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde".split(),
}


def language(text: Column) -> Column:
    """The language with most stop words among the first 100 000 characters; null if there are none. Ties: by name."""
    own = words(F.lower(F.substring(text, 1, 100_000)))
    scored = F.array(*[F.struct(F.size(F.filter(own, _in(stop))).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, stop) in enumerate(sorted(STOP_WORDS.items()))])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["lang"])


def _in(values: Sequence[str]):
    return lambda w: w.isin(list(values))


def file_article_estimate(name: Column) -> Column:
    """Last minus first page number of a dump file's name."""
    part = lambda i: F.regexp_extract(name, r"xml-p(\d+)p(\d+)\.", i).cast("long")
    return part(2) - part(1)


def output_name(path: Column, start: int = 27, end: int = 4) -> Column:
    """A file's base name without its first `start` and last `end` characters, '' if nothing is left."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.substring(base, F.lit(start + 1), F.greatest(F.length(base) - start - end, F.lit(0)))


def sample_line(task: Column, n: Column, of: Column, fields: Sequence[Column], src_tokens: Column, tgt_tokens: Column, src_diff: Column, tgt_diff: Column, mark: str = "^") -> Column:
    """A log line of a sampled revision: [task] n/of, the fields, [tokens|tokens], [changed], [changed], parted by the mark; null is ''."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    size = lambda c: F.when(c.isNull(), "0").otherwise(F.size(c).cast("string"))
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit("")), F.lit("]"))
    head = F.concat(F.lit("["), some(task), F.lit("] "), some(n), F.lit("/"), some(of))
    sizes = F.concat(F.lit("["), size(src_tokens), F.lit("|"), size(tgt_tokens), F.lit("]"))
    return F.concat_ws(mark, head, *[some(c) for c in fields], sizes, listed(src_diff), listed(tgt_diff))


def roman(n: int) -> str:
    """Roman numeral of a positive number."""
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + sign * (n // value), n % value
    return out
