"""Column functions over text. All are built-in expressions and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as V


def text_of(c) -> Column:
    """Missing text counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A Column is an expression, not a variable: used inside a lambda over an array it would be computed
    again for every element. Bound as a lambda argument it is computed once.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def terms(c: Column) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({V.WORD}{{2,}})"), F.lit(1))


def counted(words: Column) -> Column:
    """array<struct<term,tf>> of an array of words without nulls, sorted by term.

    In the sorted array the places where two neighbouring terms begin differ by the count of the first. One pass finds them.
    """
    def rows(s: Column, first: Column) -> Column:
        return F.transform(first, lambda at, i: F.struct(
            F.get(s, at).alias("term"),
            (F.coalesce(F.get(first, i + 1), F.size(s)) - at).cast("long").alias("tf")))
    places = lambda s: F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    return let(F.sort_array(words), lambda s: let(places(s), lambda first: rows(s, first)))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def jaccard_words(a: Column, b: Column) -> Column:
    def score(x: Column, y: Column) -> Column:
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(
            F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return let(word_set(a), lambda x: let(word_set(b), lambda y: score(x, y)))


def word_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    return let(word_set(query), lambda q: ratio(F.size(F.array_intersect(q, word_set(text))), F.size(q)))


def contains_any(c: Column, words: list[str]) -> Column:
    """``c`` (already lower case) has one of the words as a substring."""
    test = F.lit(False)
    for w in words:
        test = test | F.contains(c, F.lit(w))
    return test


def count_contained(c: Column, words: list[str]) -> Column:
    n = F.lit(0)
    for w in words:
        n = n + F.contains(c, F.lit(w)).cast("int")
    return n


def occurrences(text: Column, word: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty word."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


# --- corpus preparation -------------------------------------------------------------------

def _whole_line(patterns: list[str]) -> str:
    return "(?i)^(?:" + "|".join(patterns) + ")$"


NOISE_LINE = _whole_line(V.NOISE_LINES)
TOC_FOOTER_LINE = _whole_line(V.TOC_FOOTER_LINES)
TOC_HEADER_LINE = _whole_line(V.TOC_HEADER_LINES)


def filter_noise_lines(c: Column) -> Column:
    def keep(lines: Column, line: Column, i: Column) -> Column:
        bare = strip(line)
        ahead = F.array_join(F.slice(lines, i + 1, F.lit(5)), "\n")
        real_toc = bare.rlike(TOC_HEADER_LINE) & ahead.rlike("(?i)" + V.TOC_STRUCTURE)
        return real_toc | ~(bare.rlike(TOC_FOOTER_LINE) | bare.rlike(NOISE_LINE)) | (bare == "")

    return let(F.split(c, "\n"), lambda lines: F.array_join(F.filter(lines, lambda x, i: keep(lines, x, i)), "\n"))


def repair_line_breaks(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n")
    c = F.regexp_replace(c, r"\n\s*-\s*(?=[A-Z])", "\n- ")
    c = F.regexp_replace(c, r"\n\s*•\s*(?=[A-Z])", "\n• ")
    c = F.regexp_replace(c, r"\n(?=\s*[a-z])", " ")
    c = F.regexp_replace(c, r"\n\s*(\d+\.)\s*(?=[A-Z])", "\n$1 ")
    return F.regexp_replace(c, r"\n\s*[.,;:]\s*\n", "\n")


def drop_thin_lines(c: Column) -> Column:
    kept = F.filter(F.split(c, "\n"), lambda x: (F.length(strip(x)) >= 10) | x.rlike(V.WORD))
    return F.array_join(kept, "\n")


def prepare_text(c: Column) -> Column:
    return drop_thin_lines(repair_line_breaks(filter_noise_lines(c)))


def chunk_is_valid(c: Column) -> Column:
    bare = strip(c)
    return ((F.length(bare) >= 50) & c.rlike("[a-zA-Z]")
            & ~bare.rlike(NOISE_LINE) & ~bare.rlike(TOC_FOOTER_LINE))


def trim_to_sentence(c: Column) -> Column:
    tail_len = F.greatest(F.least(F.lit(99), F.length(c) - 1), F.lit(0))
    head = F.substring(c, F.lit(1), F.length(c) - tail_len)
    tail = F.substring(c, F.length(c) - tail_len + 1, tail_len)
    cut = F.regexp_extract(tail, r"(?s)^(.*[.!?\n])", 1)
    return F.when(rstrip(c).rlike(r"[.!?]$") | (cut == ""), c).otherwise(rstrip(F.concat(head, cut)))


def clean_context(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, rf"({V.WORD})-\s*({V.WORD})", "$1$2")
    c = F.regexp_replace(c, r"(?is)Table of Contents.*", "")
    c = F.regexp_replace(c, r"\. ([A-Z])", ".\n\n$1")
    return strip(c)


def page_to_text(html: Column) -> Column:
    """Marked-up page to plain text; a link keeps its target as ``text [URL: target]``."""
    c = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "$2 [URL: $1]")
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/div|/h\d|/li|/tr|/article)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")]:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r" ?\n[ \n]*", "\n"))


# --- extraction ---------------------------------------------------------------------------

RAW_URL = r"(?:^|[^(])(https?://[\p{L}\p{N}_./?=&%-]+)"


def extract_links(c: Column) -> Column:
    """array<struct<text,url>>: Markdown links, HTML links, then addresses not seen yet."""
    def pairs(pattern: str, text_group: int, url_group: int) -> Column:
        return F.zip_with(F.regexp_extract_all(c, F.lit(pattern), F.lit(text_group)),
                          F.regexp_extract_all(c, F.lit(pattern), F.lit(url_group)),
                          lambda t, u: F.struct(t.alias("text"), u.alias("url")))

    linked = F.concat(pairs(r"\[([^\]]+)\]\(([^)]+)\)", 1, 2),
                      pairs(r'<a\s+href="([^"]+)"[^>]*>([^<]+)</a>', 2, 1))
    raw = F.array_except(F.regexp_extract_all(c, F.lit(RAW_URL), F.lit(1)),
                         F.transform(linked, lambda x: x["url"]))
    return F.concat(linked, F.transform(raw, lambda u: F.struct(u.alias("text"), u.alias("url"))))


CODE_BLOCK = r"```([a-zA-Z0-9]*)\n([\s\S]*?)```"


def extract_code_blocks(c: Column) -> Column:
    return F.zip_with(
        F.regexp_extract_all(c, F.lit(CODE_BLOCK), F.lit(1)),
        F.regexp_extract_all(c, F.lit(CODE_BLOCK), F.lit(2)),
        lambda lang, code: F.struct(F.when(lang == "", "text").otherwise(lang).alias("language"),
                                    strip(code).alias("code")))


def _line_items(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip)


def extract_bullets(c: Column) -> Column:
    return _line_items(c, r"(?dm)^\s*[-*]\s+(.+)$")


def extract_numbered(c: Column) -> Column:
    return _line_items(c, r"(?dm)^\s*\d+[.)]\s+(.+)$")


# Word limits are marked with two control characters, so that one pattern without look-around
# finds runs of whole words.
PHRASE = "(\x02[A-Z][a-zA-Z]*\x03(?:\\s+\x02[A-Z][a-zA-Z]*\x03){0,5})"


def extract_key_terms(c: Column, most: int = 10) -> Column:
    """Capitalised phrases of up to six words, without common words, the first ``most``."""
    marked = F.regexp_replace(c, rf"({V.WORD}+)", "\x02$1\x03")
    found = F.transform(F.regexp_extract_all(marked, F.lit(PHRASE), F.lit(1)),
                        lambda t: F.translate(t, "\x02\x03", ""))
    common = F.array(*[F.lit(w) for w in V.COMMON_CAPITALISED])
    return F.slice(F.filter(found, lambda t: ~F.array_contains(common, t) & (F.length(t) > 2)), 1, most)


def extract_heading(c: Column) -> Column:
    title = F.regexp_extract(c, r"^([\p{L}\p{N}_\s\-]+)(?:\n|:)", 1)
    sentence = F.regexp_extract(c, r"^([^.!?]+[.!?])", 1)
    return F.when(title != "", strip(title)).when(sentence != "", strip(sentence)).otherwise(
        F.concat(strip(F.left(c, F.lit(50))), F.lit("...")))


def extract_facts(c: Column) -> Column:
    """Set of telephone, number and money tokens, sorted."""
    def whole(pattern: str) -> Column:
        return F.regexp_extract_all(
            c, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({pattern})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(
        whole(V.PHONE), whole(V.NUMBER), F.regexp_extract_all(c, F.lit(f"({V.MONEY})"), F.lit(1)))))


def normalize_text(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"\s+", " ")
    return strip(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))


def containment(a: Column, b: Column) -> Column:
    """Shorter length / longer length if one normalised text contains the other, else 0."""
    x, y = normalize_text(a), normalize_text(b)
    return (F.when(F.contains(y, x), ratio(F.length(x), F.length(y)))
            .when(F.contains(x, y), ratio(F.length(y), F.length(x))).otherwise(F.lit(0.0)))


def confidence_score(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"Confidence score: (\d+)%", 1), F.lit("")).cast("int")


def confidence_band(score: Column) -> Column:
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, words in V.CONFIDENCE_BANDS:
        band = band.when(score > limit, words)
    return band.otherwise(V.CONFIDENCE_FLOOR)


def uncertain_spans(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)<uncertain>(.*?)</uncertain>"), F.lit(1))


def term_distinctions(c: Column, patterns: list[str] = V.TERM_DISTINCTIONS) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(f"(?i)({p})"), F.lit(1)) for p in patterns])


def confusion_warning(c: Column, pairs: list[tuple[str, str]] = V.CONFUSED_TERMS) -> Column:
    return F.coalesce(*[F.when(c.rlike("(?id)" + p), note) for p, note in pairs])


def has_numbered_steps(c: Column) -> Column:
    return c.rlike(r"(?:[1-9]|10)[.)]")


def has_bullets(c: Column) -> Column:
    return F.contains(c, F.lit("•")) | F.contains(c, F.lit("*")) | c.rlike(r"(?m)^\s*-\s")


def has_examples(c: Column) -> Column:
    return contains_any(F.lower(c), ["example", "for instance"])


def sanitize(c: Column) -> Column:
    """Break fences of three backticks and drop NUL characters."""
    return F.replace(F.replace(c, F.lit("```"), F.lit("\\`\\`\\`")), F.lit("\u0000"), F.lit(""))


def clean_filename(c: Column) -> Column:
    """Replace forbidden characters, strip dots and spaces, keep at most 255 with the extension."""
    bare = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    ext = F.regexp_extract(bare, r"[^.](\.[^.]*)$", 1)
    bare = F.when(F.length(bare) > 255, F.concat(
        F.substring(bare, F.lit(1), F.lit(255) - F.length(ext)), ext)).otherwise(bare)
    return F.when(bare == "", "unnamed_file").otherwise(bare)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit("...")))


def query_hash(c: Column) -> Column:
    return F.xxhash64(F.lower(strip(c)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def specificity(c: Column) -> Column:
    return F.least(count_contained(F.lower(c), V.SPECIFIC_MARKS) / 3.0, F.lit(1.0))


def completeness_by_length(c: Column) -> Column:
    return (F.when((c == "") | (c == "ERROR"), 0.0).when(F.length(c) < 100, 0.3)
            .when(F.length(c) < 250, 0.7).otherwise(1.0))
