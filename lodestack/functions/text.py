"""Text, JSON and path functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.split() knows it, for Java's regular expressions.
WS = r"\s\x1c-\x1f\x85   -     　"
#: The same, as the characters themselves.
WHITE = "".join(re.findall(f"[{WS}]", "".join(map(chr, range(0x3001))), re.ASCII))

# The vocabularies of the rule verifier, matched as whole words in any case.
FAULT_TERMS = "fault|faulted|faulting|fracture|throw|offset|discontinuity|disrupted"
ABSENCE_TERMS = "no|none|absent|without|not detected|not visible|does not show|do not show"
CERTAINTY_TERMS = "definitely|certainly|proves|clearly indicates|high-confidence|unambiguous"
UNCERTAINTY_TERMS = "possible|possibly|likely|may|might|suggests|ambiguous|uncertain"
#: Longest claim, and how much of a longer one is kept before the dots.
CLAIM_CHARS, CUT_CHARS = 600, 597


def filled(*columns: Column) -> Column:
    """The first that is neither null nor an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def filled_array(column: Column) -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(column, F.array())


def strip(text: Column, chars: str = WS) -> Column:
    """text without leading and trailing characters of a class (white space by default)."""
    if chars == WS:
        return F.btrim(text, F.lit(WHITE))  # reads a long text once, where an expression is tried at each of its characters
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def one_line(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def normalized_claim(answer: Column) -> Column:
    """One line of CLAIM_CHARS at most; a longer one ends at a whole word, if it has two, and with three dots."""
    text = one_line(F.coalesce(answer, F.lit("")))
    cut = F.regexp_replace(F.substring(text, 1, CUT_CHARS), " [^ ]*$", "")
    return F.when(F.length(text) > CLAIM_CHARS, F.concat(cut, F.lit("..."))).otherwise(text)


def mentions(text: Column, terms: str) -> Column:
    """Whether a whole word of terms (joined by |) is in text; letters of any script bound words."""
    return text.rlike(rf"(?iU)\b({terms})\b")


def parsed_object(text: Column) -> Column:
    """VARIANT of a JSON text, or of the part from its first { to its last }, or null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def spelled(v: Column) -> Column:
    """A VARIANT scalar as Python spells it: True, False and None, texts as they are."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(F.is_variant_null(v), F.lit("None")).otherwise(text)


def _steps(array_of_variants: Column) -> Column:
    texts = F.transform(array_of_variants, lambda v: strip(F.coalesce(spelled(v), F.lit(""))))
    return F.filter(texts, lambda t: t != "")


NO_STEPS = "cast(array() as array<string>)"


def split_reasoning(text: Column) -> Column:
    """struct(reasoning array<string>, answer string) of a model's reply.

    Tried in order: a JSON object with an answer; a line `final answer: ...` with steps before it; a JSON array whose last element
    is the answer; else the whole text is the answer.
    """
    text = strip(F.coalesce(text.cast("string"), F.lit("")))
    none = F.expr(NO_STEPS)

    def made(steps: Column, answer: Column) -> Column:
        return F.struct(steps.alias("reasoning"), answer.alias("answer"))

    obj = parsed_object(text)
    is_obj = F.schema_of_variant(obj).startswith("OBJECT")
    reasoning = F.try_variant_get(obj, "$.reasoning", "variant")
    kind = F.schema_of_variant(reasoning)
    obj_steps = (
        F.when(kind == "STRING", F.filter(F.array(strip(F.try_variant_get(obj, "$.reasoning", "string"))), lambda t: t != ""))
        .when(kind.startswith("ARRAY"), _steps(F.try_variant_get(obj, "$.reasoning", "array<variant>")))
        .otherwise(none)
    )

    def truthy(path: str) -> Column:
        v = F.try_variant_get(obj, path, "variant")
        shown = spelled(v)
        return F.when(F.is_variant_null(v) | shown.isin("False", "0", "0.0", ""), None).otherwise(shown)

    obj_answer = strip(F.coalesce(truthy("$.final_answer"), truthy("$.answer"), F.lit("")))
    marked = r"(?is)^(.*?)\bfinal[_ ]answer\s*:\s*(.+)$"
    marked_answer = F.regexp_replace(strip(F.regexp_extract(text, marked, 2)), '^"+|"+$', "")
    before = strip(F.regexp_extract(text, marked, 1))
    listed = F.try_parse_json(before)
    plain = F.filter(F.split(before, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda t: ~strip(t).isin("", "[", "]"))
    lines = F.transform(plain, lambda t: F.regexp_replace(strip(F.regexp_replace(strip(t), r"^[-*]+|[-*]+$", "")), '^"+|"+$', ""))
    marked_steps = (
        F.when(F.schema_of_variant(listed).startswith("ARRAY"), _steps(F.try_variant_get(listed, "$", "array<variant>")))
        .when(before != "", lines)
        .otherwise(none)
    )
    whole = F.try_parse_json(text)
    all_steps = F.when(F.schema_of_variant(whole).startswith("ARRAY"), _steps(F.try_variant_get(whole, "$", "array<variant>"))).otherwise(none)
    return (
        F.when(is_obj & (obj_answer != ""), made(obj_steps, obj_answer))
        .when(marked_answer != "", made(marked_steps, marked_answer))
        .when(F.size(all_steps) > 0, made(F.slice(all_steps, F.lit(1), F.size(all_steps) - 1), F.element_at(all_steps, -1)))
        .otherwise(made(none, text))
    )


def joined_reasoning(reasoning: Column, answer: Column) -> Column:
    """Steps without trailing dots and the answer, in one paragraph."""
    kept = F.filter(reasoning, lambda t: strip(t) != "")
    steps = F.array_join(F.transform(kept, lambda t: F.rtrim(strip(t), F.lit("."))), ". ")
    return bound(steps, lambda s: F.when(F.coalesce(s, F.lit("")) != "", F.concat(s, F.lit(". "), answer)).otherwise(answer))


def rendered(template: str, **values: Column) -> Column:
    """template with each {name} replaced by a column; doubled braces stand for themselves."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    out = [F.lit({"{{": "{", "}}": "}"}.get(p, p)) if p in ("{{", "}}") or not p.startswith("{") else values[p[1:-1]] for p in parts if p]
    return F.concat(*out) if out else F.lit("")


#: Prompts of the generation step; any text with the same fields can take their place.
QUESTION_PROMPT = "Look at the image and ask one specific question that an expert could answer from what is visible. Return the question only."
ANSWER_PROMPT = "Question: {question}\nDetections of the auxiliary detector: {detections}\n\nReason from the visible evidence, treat detections as hints, and reply as JSON with the keys reasoning and final_answer."
SECOND_PROMPT = "Question: {question}\nAnswer from general knowledge of the field in a few sentences."
MERGE_PROMPT = (
    "Question: {question}\nDetections of the auxiliary detector: {detections}\nFirst reasoning: {first_reasoning}\nFirst answer: {first_answer}\n"
    "Second reasoning: {second_reasoning}\nSecond answer: {second_answer}\n\nMerge both into one careful answer, as JSON with the keys reasoning and final_answer."
)
DEFAULT_QUESTION = "Describe what the image shows and which of it is uncertain."


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def human_bytes(size: Column) -> Column:
    """Bytes in B, KB, MB, GB or TB with one decimal."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))

    def shown(value: Column) -> Column:
        power = sum(((value >= float(1024**k)).cast("int") for k in range(2, 5)), (value >= 1024.0).cast("int"))
        return F.concat(fixed(value / F.pow(F.lit(1024.0), power), 1), F.lit(" "), F.get(units, power))

    return bound(size.cast("double"), shown)


def scaled_exactly(x: Column, digits: int) -> Column:
    """x * 10**digits as a whole number: the nearest to the *binary* value of x, ties to even, as Python's round() and %f take it.

    The product's own rounding error is recovered by splitting x in two halves of its bits, so no decimal string is made.
    """
    scale = float(10**digits)

    def nearest(v: Column) -> Column:
        big = v * F.lit(134217729.0)
        high = big - (big - v)
        product = v * scale
        error = (high * scale - product) + (v - high) * scale
        whole = F.floor(product)
        rest = (product - whole - 0.5) + error
        return whole + F.when((rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2)) == 1)), F.lit(1)).otherwise(F.lit(0))

    return bound(x.cast("double"), nearest).cast("bigint")


def rounded(x: Column, digits: int) -> Column:
    """x rounded as Python's round(x, digits)."""
    return scaled_exactly(x, digits).cast("double") / float(10**digits)


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, as Python's '%.nf'."""
    ten = 10**digits

    def shown(v: Column) -> Column:
        return bound(
            scaled_exactly(F.abs(v), digits),
            lambda n: F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / F.lit(float(ten))).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), digits, "0")),
        )

    return bound(x.cast("double"), shown)


def data_url(content: Column, mime: str = "image/png") -> Column:
    """A data URL of binary content. Line breaks that base64() may put in are taken out."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\\r\\n]", ""))


#: Token ids shown of a reply that decodes to nothing, at most.
SHOWN_IDS = 64


def quoted(text: Column) -> Column:
    """text as a literal: in single quotes, or in double ones if it has the former and not the latter; back strokes, line ends, tabs and other control characters are spelled."""
    double = text.contains("'") & ~text.contains('"')
    spelled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        spelled = F.replace(spelled, F.lit(sign), F.lit("\\" + name))
    for code in (*range(9), 11, 12, *range(14, 32), *range(127, 161), 173):
        spelled = F.replace(spelled, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    mark = F.when(double, '"').otherwise("'")
    return F.concat(mark, F.when(double, spelled).otherwise(F.replace(spelled, F.lit("'"), F.lit("\\'"))), mark)


def chosen_decoding(candidates: Column, ids: Column | None = None, unknown: str = "<unk>") -> Column:
    """The first candidate with text, one leading unknown token taken off, from behind its last `Answer:`; if nothing is left and ids are given, a note with the last candidate and the ids."""
    cleaned = F.transform(candidates, lambda t: bound(strip(t), lambda s: F.when(s.startswith(unknown), strip(F.substring(s, F.lit(len(unknown) + 1), F.length(s)))).otherwise(s)))
    good = F.filter(cleaned, lambda t: t != "")
    text = strip(F.substring_index(F.coalesce(F.get(good, F.lit(0)), F.lit("")), "Answer:", -1))
    if ids is None:
        return text
    raw = F.coalesce(strip(F.try_element_at(candidates, F.lit(-1))), F.lit(""))
    shown = F.array_join(F.transform(F.slice(ids, 1, SHOWN_IDS), lambda i: i.cast("string")), ", ")
    note = F.concat(F.lit("[empty decoded output] raw="), quoted(raw), F.lit(" token_ids=["), shown, F.lit("]"))
    return bound(text, lambda t: F.when(t != "", t).otherwise(note))


# --- paths

def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*/*$", "")


def path_order(path: Column) -> Column:
    """Sort key: a path's parts, so a folder's files come before those of a longer-named neighbour."""
    return F.split(path, "/")


# --- chat replies

def message_content(message: Column) -> Column:
    """Text of a reply's message (VARIANT): content, as text or as the texts of a list; else its text; else null."""
    content = F.try_variant_get(message, "$.content", "variant")
    kind = F.schema_of_variant(content)
    items = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", strip(F.try_variant_get(v, "$.text", "string"))),
    )
    from_list = F.array_join(F.filter(items, lambda t: t.isNotNull() & (t != "")), "\n")
    text = F.try_variant_get(message, "$.text", "variant")
    return filled(
        F.when(kind == "STRING", strip(F.try_variant_get(content, "$", "string"))),
        F.when(kind.startswith("ARRAY"), from_list),
        F.when(F.schema_of_variant(text) == "STRING", strip(F.try_variant_get(text, "$", "string"))),
    )


def reply_text(response: Column, include_reasoning: bool = False, reasoning_as_content: bool = False) -> Column:
    """struct(text, error) of a chat response in JSON: the content, with the reasoning put in if asked for; why there is none otherwise."""
    v = F.try_parse_json(response)
    message = F.try_variant_get(v, "$.choices[0].message", "variant")

    def texted(path: str) -> Column:
        own = F.try_variant_get(message, path, "variant")
        return F.when(F.schema_of_variant(own) == "STRING", strip(F.try_variant_get(own, "$", "string")))

    content, reasoning = message_content(message), F.coalesce(filled(texted("$.reasoning_content"), texted("$.reasoning")), F.lit(""))
    text = with_reasoning(content, reasoning) if include_reasoning else content
    if reasoning_as_content:
        text = filled(text, reasoning)
    ended = F.concat(F.lit(" (finish_reason="), F.coalesce(F.try_variant_get(v, "$.choices[0].finish_reason", "string"), F.lit("None")), F.lit("): "))
    why = (
        F.when(F.try_variant_get(v, "$.choices[0]", "variant").isNull(), F.concat(F.lit("response has no choices: "), F.substring(response, 1, 1000)))
        .when(reasoning != "", F.concat(F.lit("response has reasoning and no content"), ended, quoted(F.substring(reasoning, 1, 500))))
        .otherwise(F.concat(F.lit("response has an empty message"), ended, F.substring(response, 1, 1000)))
    )
    return F.struct(text.alias("text"), F.when(text.isNull(), why).alias("error"))


def with_reasoning(content: Column, reasoning: Column) -> Column:
    """content with the reasoning: put in its JSON object if that has none, or both in a new object."""
    v = F.try_parse_json(content)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    own = F.try_variant_get(v, "$.reasoning", "variant")
    has = own.isNotNull() & ~F.is_variant_null(own) & ~F.to_json(own).isin('""', "[]", "{}", "0", "false")
    entries = F.map_from_entries(F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: e["key"] != "reasoning"))
    merged = F.to_json(F.map_concat(entries, F.create_map(F.lit("reasoning"), F.to_variant_object(F.array(reasoning)))))
    wrapped = F.to_json(F.struct(F.array(reasoning).alias("reasoning"), content.alias("final_answer")))
    return F.when(reasoning == "", content).when(is_obj & has, F.to_json(v)).when(is_obj, merged).otherwise(wrapped)


def detections_text(detections: Column) -> Column:
    """Detections as JSON, or `none`."""
    return F.when(F.coalesce(F.size(detections), F.lit(0)) == 0, F.lit("none")).otherwise(F.to_json(detections))
