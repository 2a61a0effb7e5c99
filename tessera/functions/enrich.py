"""Enrichment and validation of texts: words, languages, topics, entities, readability, scores."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import filled, let, strip


def words(c: Column, least: int = 1) -> Column:
    """Lower-cased words of ``least`` or more letters, digits and underscores: as a run is taken whole, its
    ends need no test of their own."""
    return F.regexp_extract_all(F.lower(filled(c)), F.lit(rf"(?U)\w{{{least},}}"), 0)


def word_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in dict.fromkeys(values)])


def ranked(tokens: Column) -> Column:
    """Distinct tokens with count and first place, by count downwards and then by first place.

    The sorted (token, place) list is folded once; nothing compares all with all.
    """

    def runs(places: Column) -> Column:
        """Starts of runs of equal tokens, where a token differs from the one before it."""
        new = lambda x, k: (k == 0) | (x["w"] != F.get(places, k - 1)["w"])
        marked = F.transform(places, lambda x, k: F.when(new(x, k), F.struct(x["w"].alias("w"), x["i"].alias("i"), k.alias("k"))))
        return let(F.array_compact(marked), lambda starts: counted(starts, F.size(places)))

    def counted(starts: Column, n: Column) -> Column:
        until = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda x: x["k"]), F.array(n))
        rows = F.zip_with(starts, F.slice(until, 1, F.greatest(F.size(starts), F.lit(1))), lambda x, e: F.struct((x["k"] - e).alias("neg"), x["i"].alias("first"), x["w"].alias("word")))
        return F.transform(F.array_sort(rows), lambda r: F.struct(r["word"].alias("word"), (-r["neg"]).alias("count"), r["first"].alias("first")))

    # One struct a place, sorted by token: of equal tokens the first place is first.
    some = F.filter(tokens, lambda w: w.isNotNull())
    places = F.sort_array(F.transform(some, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.filter(let(places, runs), lambda r: r["word"].isNotNull())


def keyword_tokens(c: Column) -> Column:
    """Words that may be keywords of a text of 20 or more characters."""
    tokens = F.filter(words(c, 3), lambda w: ~w.isin(*fixed.KEYWORD_STOP_WORDS) & ~w.rlike(r"(?U)^\d+$"))
    return F.when(F.length(strip(filled(c))) >= 20, tokens).otherwise(F.array().cast("array<string>"))


def concept_tokens(c: Column) -> Column:
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*fixed.CONCEPT_STOP_WORDS))


def language(c: Column) -> Column:
    """``vi`` where over two accented letters of the list occur, else ``en``; too short: unknown."""
    letters = fixed.VIETNAMESE + fixed.VIETNAMESE.upper()
    count = F.length(filled(c)) - F.length(F.translate(filled(c), letters, ""))
    return F.when(F.length(strip(filled(c))) < 10, "unknown").when(count > 2, "vi").otherwise("en")


def content_type(subject: Column, c: Column) -> Column:
    """The type with most hits among subject and first 500 characters; the first declared wins ties."""
    combined = F.lower(F.concat(filled(subject), F.lit(" "), F.substring(filled(c), 1, 500)))
    scores = {t: sum((combined.contains(w).cast("int") for w in ws), F.lit(0)) for t, ws in fixed.CONTENT_TYPES.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "other")
    for t, s in scores.items():
        out = out.when(s == best, t)
    return out


def topics(c: Column) -> Column:
    """Sorted topics of which a keyword occurs as a substring."""

    def tagged(low: Column) -> Column:
        hits = []
        for topic in sorted(fixed.TOPICS):
            hit = F.lit(False)
            for w in fixed.TOPICS[topic]:
                hit = hit | low.contains(w.lower())
            hits.append(F.when(hit, F.lit(topic)))
        return F.array_compact(F.array(*hits))

    return let(F.lower(filled(c)), tagged)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(filled(c), F.lit(pattern), group)


def entities(c: Column, kind: str, most: int = 20) -> Column:
    """Distinct entities of a kind, sorted, the first ``most``."""
    pattern, group = fixed.ENTITY_PATTERNS[kind]
    return F.slice(F.array_sort(F.array_distinct(found(c, "(?U)" + pattern, group))), 1, most)


#: How a pattern begins that takes all capitalised words before a kind of project.
_CHAINED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+("


def _chained(c: Column, kinds: list[str]) -> Column:
    """Runs of capitalised words up to the last kind in them, as the pattern of :data:`_CHAINED` finds them, with one space
    before it. That pattern takes a stack frame for each word, which ends an executor at some thousand, and tries a
    run without a kind again from each of its words. Here loops are possessive, and such a run is taken as a whole."""
    word = "[A-Z][a-z]+"
    inner = "|".join(k for k in kinds if re.fullmatch(word, k))  # the run may go on behind these
    last = "|".join(k for k in kinds if not re.fullmatch(word, k))
    ways = [rf"{word}(?:\s+{word})*+\s+(?:{last})\b"] * bool(last) + [rf"{word}(?:(?:\s+(?!(?:{inner})\b){word})*+\s+(?:{inner})\b)++"] * bool(inner)
    runs = F.filter(found(c, rf"(?U)\b(?:({'|'.join(ways)})|{word}(?:\s+{word})*+)", 1), lambda m: m != "")
    return F.transform(runs, lambda m: F.regexp_replace(m, rf"(?U)\s+({'|'.join(kinds)})$", " $1"))


def projects(c: Column) -> Column:
    """Sorted distinct project names."""

    def matches(pattern: str, groups: int) -> Column:
        if pattern.startswith(_CHAINED):
            return _chained(c, pattern.removeprefix(_CHAINED).removesuffix(r")\b").split("|"))
        if groups == 1:
            return F.transform(found(c, "(?U)" + pattern, 1), strip)
        # The text is searched once; the groups are those of its few matches.
        return F.transform(found(c, "(?U)" + pattern), lambda m: strip(F.concat_ws(" ", *[F.regexp_extract(m, "(?U)" + pattern, g + 1) for g in range(groups)])))

    every = [matches(pattern, groups) for pattern, groups in fixed.PROJECT_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*every))))


def versions(c: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(found(c, "(?U)" + fixed.VERSION_PATTERN))), lambda v: F.concat(F.lit("version:"), v))


def file_references(c: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(found(c, "(?U)" + fixed.FILE_PATTERN, 1))), lambda v: F.concat(F.lit("file_type:"), v))


#: Extractors of further traits: functions of content and name to an array of strings.
EXTRACTORS: list[Callable[[Column, Column], Column]] = []


def register_extractor(extractor: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Adds an extractor; its traits join the others of ``concepts``."""
    EXTRACTORS.append(extractor)
    return extractor


@register_extractor
def _versions(content: Column, name: Column) -> Column:
    return versions(content)


@register_extractor
def _files(content: Column, name: Column) -> Column:
    return file_references(content)


def concept_keywords(c: Column, traits: Column | None = None) -> Column:
    """Of the 20 commonest words those that occur twice or are among the traits."""
    top = F.slice(ranked(concept_tokens(c)), 1, 20)
    lowered = F.transform(traits, F.lower) if traits is not None else F.array().cast("array<string>")
    return let(lowered, lambda low: F.transform(F.filter(top, lambda r: (r["count"] >= 2) | F.array_contains(low, r["word"])), lambda r: r["word"]))


def concepts(content: Column, name: Column) -> Column:
    """Struct of sorted traits, detected projects and topics, keywords, and entities by kind."""
    whole = F.when(filled(name) != "", F.concat(name, F.lit(" "), filled(content))).otherwise(filled(content))
    return let(whole, lambda text: _concepts(text, content, name))


def _concepts(text: Column, content: Column, name: Column) -> Column:
    return let(F.struct(projects(text).alias("projects"), topics(text).alias("topics")), lambda own: _with_own(text, own, content, name))


def _with_own(text: Column, own: Column, content: Column, name: Column) -> Column:
    both = traits = F.array_union(own["projects"], own["topics"])
    for e in EXTRACTORS:
        traits = F.array_union(traits, e(content, name))
    return F.struct(
        F.array_sort(F.array_distinct(traits)).alias("traits"),
        own["projects"].alias("projects"),
        own["topics"].alias("topics"),
        concept_keywords(text, both).alias("keywords"),
        F.struct(*[entities(text, k).alias(k) for k in fixed.ENTITY_PATTERNS]).alias("entities"),
    )


def dates(c: Column, most: int = 20) -> Column:
    """Distinct strings that look like dates, sorted, the first ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.array(*[found(c, p) for p in fixed.DATE_PATTERNS])))), 1, most)


def half_up(a: Column, b: Column, parts: int) -> Column:
    """a / b rounded to 1/parts, halves upwards: exact, since it rounds integers and not doubles."""
    return F.floor((a * (2 * parts) + b) / (b * 2)) / parts


def readability(c: Column) -> Column:
    """Struct of sentences, mean words of a sentence (one digit) and mean letters of a word (two)."""
    sentences = F.filter(F.transform(F.split(filled(c), r"[.!?]+"), strip), lambda s: s != "")
    n = F.size(sentences)
    in_sentences = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(F.split(s, r"(?U)\s+")))
    tokens = found(c, r"(?U)\b\w+\b")
    letters = F.length(F.array_join(tokens, ""))
    return F.struct(
        n.alias("sentence_count"),
        F.when(n > 0, half_up(in_sentences, n, 10)).otherwise(0.0).alias("avg_sentence_length"),
        F.when(F.size(tokens) > 0, half_up(letters, F.size(tokens), 100)).otherwise(0.0).alias("avg_word_length"),
    )


def raw_text_validation(c: Column) -> Column:
    """Struct of validity, lengths, ratios and warnings of an extracted text."""
    t = filled(c)
    total = F.greatest(F.length(t), F.lit(1))
    controls = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""))
    non_ascii = F.length(F.regexp_replace(t, r"[\x00-\x7f]", ""))
    n_words = F.regexp_count(t, F.lit(r"(?U)\b\w+\b"))
    symbols = F.length(F.regexp_replace(t, r"(?U)[\w\s]", ""))
    valid = strip(t) != ""
    control_ratio = F.when(valid, F.round(controls / total, 4)).otherwise(0.0)
    return F.struct(
        valid.alias("valid"),
        F.length(t).alias("length"),
        F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
        F.when(valid, F.round(non_ascii / total, 4)).otherwise(0.0).alias("non_ascii_ratio"),
        control_ratio.alias("control_char_ratio"),
        F.when(valid, n_words).otherwise(0).alias("word_count"),
        F.when(valid, symbols).otherwise(0).alias("symbol_count"),
        F.array_compact(F.array(
            F.when(valid & (F.length(strip(t)) < 10), F.lit("short")),
            F.when(valid & (control_ratio > 0.05), F.lit("control characters")),
            F.when(valid & (n_words > 0) & (symbols / F.greatest(n_words, F.lit(1)) > 3), F.lit("symbols")),
        )).alias("warnings"),
    )


def metadata_validation(email_id: Column, subject: Column, sender: Column, attachments: Column) -> Column:
    """Struct of validity, errors and warnings of a mail record; attachments: array of (id, filename, size)."""
    empty = lambda x: x.isNull() | (x == "")
    errors = F.concat(
        F.array_compact(F.array(F.when(empty(email_id), F.lit("email_id is empty")))),
        F.transform(F.filter(attachments, lambda a: empty(a["filename"])), lambda a: F.concat(F.lit("attachment "), F.coalesce(a["id"].cast("string"), F.lit("None")), F.lit(": filename is empty"))),
    )
    warnings = F.concat(
        F.array_compact(F.array(F.when(empty(subject), F.lit("subject is empty")), F.when(empty(sender), F.lit("sender is empty")))),
        F.transform(F.filter(attachments, lambda a: F.coalesce(a["size"], F.lit(0)) <= 0), lambda a: F.concat(F.lit("attachment "), F.coalesce(a["id"].cast("string"), F.lit("None")), F.lit(": size is 0 or negative"))),
    )
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(filled(c)), r"(?U)\s+"), lambda w: w != ""))


def attribution_score(response: Column, sources: Column) -> Column:
    """Share of the response's content words that no source has; no sources or response: 1."""
    stop = word_list(fixed.RESPONSE_STOP_WORDS)
    own = _tokens(response)
    content = F.array_except(own, stop)
    shared = F.array_intersect(content, _tokens(F.array_join(sources, " ")))
    share = F.round(1 - F.size(shared) / F.size(content), 6)
    return F.when((F.size(sources) <= 0) | (F.size(own) == 0), 1.0).when(F.size(content) == 0, 0.5).otherwise(share)


def grounding_score(response: Column, sources: Column, named: Column | None = None) -> Column:
    """Share of the capitalised phrases (and given names) that no source has; none: 0."""
    phrases = found(response, r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b")
    phrases = F.array_distinct(F.concat(phrases, named) if named is not None else phrases)
    context = F.lower(F.array_join(sources, " "))
    missing = let(context, lambda said: F.filter(phrases, lambda p: ~said.contains(F.lower(p))))
    return F.when(F.size(phrases) <= 0, 0.0).otherwise(F.round(F.size(missing) / F.size(phrases), 6))


def contradiction_score(response: Column, previous: Column) -> Column:
    """Signs of contradiction: turns, negations, and " is not " next to what an earlier statement says."""
    r = F.lower(filled(response))
    parts = F.split(r, " is not ")
    told = let(parts, lambda xs: F.filter(previous, lambda p: (F.size(xs) > 1) & F.exists(xs, lambda x: F.lower(p).contains(x))))
    hits = F.size(told)
    count = r.rlike("however|but|actually|contrary to|unlike").cast("int") + r.rlike("no|not|never|none").cast("int") + 2 * hits
    return F.when(F.size(previous) <= 0, 0.0).otherwise(F.least(count / 5, F.lit(1.0)))


def response_scores(response: Column, sources: Column, previous: Column) -> Column:
    """Struct of the three scores, their weighted sum and the flag above one half."""
    a, g, c = attribution_score(response, sources), grounding_score(response, sources), contradiction_score(response, previous)
    overall = F.round(a * 0.4 + g * 0.3 + c * 0.3, 4)
    return F.struct(a.alias("attribution"), g.alias("entity_grounding"), c.alias("contradiction"), overall.alias("overall"), (overall > 0.5).alias("flagged"))


def embedded_content(content: Column, space: str = r"(?U)\s") -> Column:
    """The first 10000 characters of a content, runs of white space (``space``, as a pattern) as one space."""
    return F.regexp_replace(F.substring(content, 1, 10000), space + "+", " ")


def embedding_text(name: Column, summary: Column, content: Column, traits: Column, keywords: Column) -> Column:
    """What a node says, joined by bars: name, summary, 10000 characters of content, traits, keywords."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" | ", some(name), some(summary), some(embedded_content(content)), some(F.array_join(traits, " ")), some(F.array_join(keywords, " ")))
