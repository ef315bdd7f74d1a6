"""String expressions of the linking pipeline, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Model numbers, after white space: letters and digits; letters, dashes, digits; letters, a dash, letters and digits;
#: a word and a number between white space.
MODEL = r"\s[a-zA-Z]+[0-9]+\w*|\s[a-zA-Z]+-+[0-9]+\w*|\s[a-zA-Z]+-[a-zA-Z]+[0-9]+\w*|\s[a-zA-Z]+\s[0-9]+\s"
#: Platforms and versions, which aren't.
NOT_MODELS = ("ps3", "ps4", "ps5", "PS4", "PS5", "PS3", "playstation 4", "playstation 3", "playstation 5", "PlayStation 4", "PlayStation 3", "PlayStation 5", "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8")
#: Phrases by which an answer says that there is none.
NO_ANSWER = ("not mentioned", "not specified", "no information", "unknown", "n/a")


def clean_name(c: Column) -> Column:
    """Trimmed, with `_` and `-` as spaces and without quotes."""
    return F.trim(F.regexp_replace(F.translate(c, "_-", "  "), "[\"']", ""))


def entity_name(url: Column) -> Column:
    """The page name of a wiki address: no prefix, no quotes, percent-decoded."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(url, r"^https?://[^/]+/(?:wiki/)?", "")), "[\"']", "")


def model_versions(c: Column) -> Column:
    """Model numbers of a text, in order, without NOT_MODELS."""
    found = F.transform(F.regexp_extract_all(c, F.lit(MODEL), F.lit(0)), lambda m: F.regexp_replace(m, r"^\s+|\s+$", ""))
    return F.filter(found, lambda m: ~m.isin(*NOT_MODELS))


#: Numerals: numbers with or without decimals; and those of products, which are letters with a number, or decimals.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
PRODUCT_NUMBER = r"([a-zA-Z]+[0-9]+\w*|[0-9]+\.[0-9]+)"


def numerals(c: Column, form: str = NUMBER) -> Column:
    return F.regexp_extract_all(c, F.lit(form), F.lit(1))


def numerals_match(value: Column, text: Column, form: str = NUMBER) -> Column:
    """Whether all numerals of the value are in the text; false if it has none."""
    n, t = numerals(value, form), numerals(text, form)
    return (F.size(n) > 0) & F.forall(n, lambda x: F.array_contains(t, x))


#: Short words that are no attribute values.
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "in", "is", "it", "no", "of", "on", "or", "the", "this", "to", "with")


def usable_value(c: Column) -> Column:
    """Whether a value says something: more than a sign, no stop word, not digits alone."""
    return (F.length(c) > 1) & ~c.isin(*STOP_WORDS) & ~c.rlike("^[0-9]+$")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def is_sublist(part: Column, whole: Column) -> Column:
    """Whether the tokens of one text stand side by side, in order, in another's."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return (F.size(tokens(part)) > 0) & F.contains(pad(whole), pad(part))


def title_parts(c: Column) -> Column:
    """struct(brand, name, color) of a title of three parts, else nulls."""
    p = F.split(c, " - ")
    three = F.size(p) == 3
    return F.struct(*[F.when(three, F.trim(p[k])).alias(n) for k, n in enumerate(("brand", "name", "color"))])


def strip_max_height(url: Column) -> Column:
    return F.split_part(url, F.lit(";"), F.lit(1))


def strip_tags(html: Column) -> Column:
    """Text without tags; scripts, styles and comments go with what they hold."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def unescape(c: Column) -> Column:
    """The five named character references of XML."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def options(values: Column, limit: int = 10) -> Column:
    """`A. first B. second ...` of at most `limit` options."""
    return F.array_join(F.transform(F.slice(values, 1, limit), lambda v, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), v)), " ")


def chosen_option(answer: Column, values: Column) -> Column:
    """The option that an answer names by its letter (`B. value` or `B`), else the first one that the answer has in it;
    null where the answer says that there is none."""
    letter = F.regexp_extract(answer, r"^\s*([A-J])(?:[.):]|\s*$)", 1)
    by_letter = F.when(letter != "", F.try_element_at(values, F.ascii(letter) - 64))
    inside = F.try_element_at(F.filter(values, lambda v: F.contains(F.lower(answer), F.lower(v))), F.lit(1))
    none = F.exists(F.array(*[F.lit(p) for p in NO_ANSWER]), lambda p: F.contains(F.lower(answer), p))
    return F.when(~none, F.coalesce(by_letter, inside))


#: Phrases and words by which a free answer says that there is no value.
VETO = ("not mentioned", "not provide", "not enough information", "not mention", "no clear", "not specified", "not possible", "no specific", "not provided", "not specify", "no clear indication", "no indication", "no information", "impossible")
VETO_WORDS = ("no", "not", "none")
#: How a free answer names the value of a key ({0}) of a mention ({1}).
TEMPLATES = ("The {0} of the {1} based on this review is ", "The {0} of the {1} is ", "The {0} of the {1} mentioned in the review is ")


def parsed_answer(answer: Column, values: Column, mention: Column, key: Column) -> Column:
    """struct(found, beyond): what a free answer says of a key, in a cascade. An option letter and what follows it; else the values
    that are part of the answer or that it is part of; else the values in it in lower case; else, if nothing in the answer says that
    there is none, what follows one of TEMPLATES, which may be none of the values (`beyond`)."""
    none = F.array().cast("array<string>")
    lettered = F.when(answer.rlike(r"^[A-J]\. "), F.array(F.substring(answer, F.lit(4), F.length(answer))))
    partly = F.filter(values, lambda v: F.contains(answer, v) | F.contains(v, answer))
    lowered = F.filter(values, lambda v: F.contains(F.lower(answer), v))
    found = F.coalesce(lettered, F.when(F.size(partly) > 0, partly), F.when(F.size(lowered) > 0, lowered), none)
    veto = F.exists(F.array(*[F.lit(p) for p in VETO]), lambda p: F.contains(answer, p)) | F.arrays_overlap(F.split(answer, r"[^A-Za-z0-9']+"), F.array(*[F.lit(w) for w in VETO_WORDS]))

    def behind(template: str) -> Column:
        lead = F.replace(F.replace(F.lit(template), F.lit("{0}"), key), F.lit("{1}"), mention)
        rest = F.regexp_replace(F.regexp_replace(F.substring(answer, F.length(lead) + 1, F.length(answer)), r"\.$", ""), r"^[A-J]\. ", "")
        return F.when(F.contains(F.lower(answer), F.lower(lead)), rest)

    beyond = F.when((F.size(found) == 0) & ~veto, F.filter(F.array(*[behind(t) for t in TEMPLATES]), lambda v: v.isNotNull())).otherwise(none)
    return F.struct(found.alias("found"), beyond.alias("beyond"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def numbered_file(id_: Column, url: Column) -> Column:
    """`0000042-name.jpg`."""
    return F.concat(F.lpad(id_.cast("string"), 7, "0"), F.lit("-"), file_name(url))


def truncated(c: Column, n: int) -> Column:
    """The first n space-separated tokens."""
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def paragraphs(c: Column, n: int) -> Column:
    """Sentences joined n at a time."""
    s = sentences(c)
    count = F.ceil(F.size(s) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.array_join(F.slice(s, k * n + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def entity_markup(c: Column) -> Column:
    """Tokens and B-, I- or O tags of text with [span](TYPE) markup, as `token/tag`."""
    parts = F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]\([A-Z]+\)|[^\s\[]+)"), F.lit(1))

    def tagged(p: Column) -> Column:
        span = F.split(F.regexp_extract(p, r"^\[([^\]]*)\]", 1), " ")
        kind = F.regexp_extract(p, r"\(([A-Z]+)\)$", 1)
        inside = F.transform(span, lambda t, i: F.concat(t, F.when(i == 0, F.lit("/B-")).otherwise(F.lit("/I-")), kind))
        return F.when(p.startswith("["), inside).otherwise(F.array(F.concat(p, F.lit("/O"))))

    return F.flatten(F.transform(parts, tagged))


def _ascii(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form is dropped."""
    return texts.map(_ascii)


#: Words whose base form no rule gives, by part of speech.
IRREGULAR = {
    "noun": {"children": "child", "feet": "foot", "geese": "goose", "men": "man", "mice": "mouse", "people": "person", "teeth": "tooth", "women": "woman"},
    "verb": {"are": "be", "been": "be", "bought": "buy", "did": "do", "done": "do", "gave": "give", "got": "get", "had": "have", "has": "have", "is": "be", "made": "make", "said": "say", "took": "take", "was": "be", "went": "go", "were": "be"},
}
#: Rules by part of speech, the first that fits counts: an ending, what stands in its place, and the letters that a word must have.
RULES = {
    "noun": (("ss", "ss", 2), ("us", "us", 2), ("is", "is", 2), ("ies", "y", 5), ("ches", "ch", 5), ("shes", "sh", 5), ("sses", "ss", 5), ("xes", "x", 4), ("s", "", 4)),
    "verb": (("ss", "ss", 2), ("ies", "y", 5), ("ied", "y", 5), ("ches", "ch", 5), ("shes", "sh", 5), ("sses", "ss", 5), ("xes", "x", 4), ("ings", "", 7), ("ing", "", 6), ("ed", "", 5), ("s", "", 4)),
}


def lemma(word: Column, pos: str = "verb") -> Column:
    """The base form of a word in lower case, as a noun or a verb: irregular ones by a list, others by rules on their ending."""
    w = F.lower(word)
    out = w
    for ending, new, least in reversed(RULES[pos]):
        out = F.when(w.endswith(ending) & (F.length(w) >= least), F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(new))).otherwise(out)
    for form, base in IRREGULAR[pos].items():
        out = F.when(w == form, base).otherwise(out)
    return out


def lemma_sql(w: str, pos: str = "verb") -> str:
    """The same in SQL, of a word in lower case."""
    listed = " ".join(f"WHEN {w} = '{form}' THEN '{base}'" for form, base in reversed(IRREGULAR[pos].items()))
    ruled = " ".join(f"WHEN suffix({w}, '{ending}') AND length({w}) >= {least} THEN substr({w}, 1, length({w}) - {len(ending)}) || '{new}'" for ending, new, least in RULES[pos])
    return f"CASE {listed} {ruled} ELSE {w} END"


def lemmas(words: Column) -> Column:
    return F.transform(words, lambda w: lemma(w))


def base_form_span(text: Column, query: Column) -> Column:
    """Where a query stands in a text: as it is, in any case; else the first words side by side with the same lemmas; null if
    neither."""
    at = F.position(F.lower(query), F.lower(text))
    words, wanted = F.split(text, " "), F.split(query, " ")
    n = F.size(wanted)
    windows = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n)))
    alike = F.filter(windows, lambda w: lemmas(w) == lemmas(wanted))
    return F.when(at > 0, F.substring(text, at, F.length(query))).otherwise(F.array_join(F.try_element_at(alike, F.lit(1)), " "))


def tagged_values(values: Column, tag: str) -> Column:
    """` TAG: v. v.` of an array of values; nothing of an empty one."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f" {tag}: "), F.array_join(values, ". "), F.lit("."))).otherwise(F.lit(""))


def raw_texts(texts: Column) -> Column:
    """` RAW: a. b.` of what was read from images."""
    return F.concat(F.lit(" RAW: "), F.array_join(texts, ". "), F.lit("."))
