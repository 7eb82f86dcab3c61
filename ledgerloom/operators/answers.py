"""Natural-language answers: contract, reading, bounded repairs and grading, as expressions over Variant values.

A response is read as one JSON value, bare or in a code fence; one that is none is read as words, by the caller's
``Wording``. The value becomes a list of members (a scalar has one), each as it was given and as it is without surplus
quotes; members, gold values and names are compared in answer form, which is the one thing that Python
computes (in Arrow batches). Numbers compare by value, so 1.0 and 1 are the same; JSON's null equals a null only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import CHUNK, relisted
from ..sources.stored import dealt
from .grade import degenerate_status

#: Quotes that may be stripped in pairs, and how many layers of them (reading JSON is one).
PAIRS, LAYERS = (('"', '"'), ("“", "”")), 2
#: The names under which repairs are reported.
UNWRAPPED, UNQUOTED = "named_object_unwrap", "surplus_quote_strip"
#: Stands behind a text to see where its JSON value ends.
_END = "␞ the end"


@dataclass(frozen=True)
class Wording:
    """How answers in words are phrased; ``{entity}`` stands for the item's company, ``{value}`` for what was asked.

    ``openings`` and ``endings`` may stand around an answer, ``nothing`` says that a set is empty, ``sentences``
    are whole answers by attribute. Case doesn't matter.
    """

    openings: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    nothing: tuple[str, ...] = ()
    sentences: dict[str, str] = field(default_factory=dict)


# JSON values


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a Variant; null for all others."""
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_END}"]'))), "$", "array<variant>")
    return F.when((F.size(inside) == 2) & (F.try_variant_get(inside[1], "$", "string") == _END) & ~text.contains(_END), inside[0])


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_plain(v: Column) -> Column:
    """A string, number or truth value."""
    return ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(ARRAY|OBJECT|VOID)")


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def contract_column(text: Column, answer_type: str | Column) -> Column:
    """Is the whole text one JSON value of the type's shape? The gold is not looked at."""
    v = whole_json(trimmed(text))
    kind = F.lit(answer_type) if isinstance(answer_type, str) else answer_type
    return F.coalesce(F.when(kind == "scalar", is_plain(v) & (F.schema_of_variant(v) != "BOOLEAN")).when(kind.isin("set", "top_k"), is_list(v)), F.lit(False))


# Readings


def unfenced(text: Column) -> Column:
    """What stands in a code fence, or the text itself; null for a fence that does not close."""
    n = F.char_length(text)
    inner = F.substring(text, F.lit(4), n - 6)
    inner = F.when(inner.startswith("json"), F.substring(inner, F.lit(5), n)).otherwise(inner)
    return F.when(~text.startswith("```"), text).when((n >= 6) & text.endswith("```"), trimmed(inner))


def _said(template: str, entity: Column) -> Column:
    """A template's text for an entity, in small letters."""
    parts = template.split("{entity}")
    return F.lower(reduce(lambda a, b: F.concat(a, entity, F.lit(b)), parts[1:], F.lit(parts[0])))


def _without(text: Column, wording: Wording, entity: Column) -> Column:
    """A text without its opening and ending."""
    for opening in wording.openings:
        said = _said(opening.rstrip(), entity)
        text = F.when(F.lower(text).startswith(said), F.ltrim(F.substring(text, F.char_length(said) + 1, F.char_length(text)))).otherwise(text)
    for ending in wording.endings:
        said = _said(ending, entity)
        text = F.when(F.lower(text).endswith(said), F.substring(text, F.lit(1), F.char_length(text) - F.char_length(said))).otherwise(text)
    return text


def _of_sentence(text: Column, wording: Wording, attribute: Column, entity: Column) -> Column:
    """The value that the attribute's sentence wraps, else the text, without full stops at the end."""
    out = F.rtrim(text, F.lit("."))
    for name, sentence in wording.sentences.items():
        head, tail = (_said(x, entity) for x in sentence.split("{value}"))
        room = F.char_length(text) - F.char_length(head) - F.char_length(tail)
        fits = (attribute == name) & F.lower(text).startswith(head) & F.lower(text).endswith(tail) & (room > 0)
        out = F.when(fits, F.substring(text, F.char_length(head) + 1, room)).otherwise(out)
    return out


def listed_words(text: Column, nothing: tuple[str, ...] = ()) -> Column:
    """The members of a list in words: semicolons part them, and lines that begin with a bullet or a number and a mark.

    Any other line goes on with the member before it. The first line may have a bullet but keeps a number.
    """
    lines = F.flatten(F.transform(F.split(text, ";"), lambda part: F.transform(F.split(part, "\n"), lambda line, i: F.struct((i == 0).alias("opens"), F.trim(line).alias("line")))))
    mark = lambda s: F.regexp_extract(s["line"], r"^(?:[-*•]|[0-9]+[.)])", 0)
    bullet = lambda s: F.when(s["opens"] & ~s["line"].rlike("^[-*•]"), "").otherwise(mark(s))
    begins = F.transform(lines, lambda s: F.struct((s["opens"] | (bullet(s) != "")).alias("opens"), F.trim(F.substring(s["line"], F.char_length(bullet(s)) + 1, F.char_length(s["line"]))).alias("line")))

    def add(done: Column, s: Column) -> Column:
        last = F.concat(F.element_at(done, -1), F.lit(" "), s["line"])
        return F.when(s["opens"] | (F.size(done) == 0), F.concat(done, F.array(s["line"]))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last)))

    members = F.filter(F.transform(F.aggregate(begins, F.array().cast("array<string>"), add), lambda m: F.rtrim(F.trim(m), F.lit("."))), lambda m: m != "")
    return F.when(F.lower(F.regexp_replace(text, r"[.!]\z", "")).isin(*nothing), F.array().cast("array<string>")).otherwise(members) if nothing else members


def stripped(text: Column) -> Column:
    """A text without one pair of quotes around it, or null if it has none."""
    t = F.trim(text)
    paired = reduce(lambda a, b: a | b, [t.startswith(x) & t.endswith(y) for x, y in PAIRS])
    return F.when((F.char_length(t) >= 2) & paired, F.substring(t, F.lit(2), F.char_length(t) - 2))


def unquoted(text: Column, decoded: Column) -> Column:
    """A text without surplus quotes: as many layers as are allowed, one less if it came out of JSON."""
    once = stripped(text)
    return F.when(decoded, F.coalesce(once, text)).otherwise(F.coalesce(stripped(once), once, text))


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def answer_forms(lists: pa.Array) -> pa.Array:
    """Answer form (NFKC, case folded, white space collapsed, no full stops at the end) of every text; ``CHUNK`` texts are Python objects at a time."""
    import unicodedata

    def form(t):
        return None if t is None else " ".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).casefold().split()).rstrip(".")

    own = lists.flatten()
    texts = own.flatten()
    forms = [pa.array([form(t) for t in texts.slice(i, CHUNK).to_pylist()], pa.string()) for i in range(0, len(texts), CHUNK)]
    return relisted(lists, relisted(own, pa.concat_arrays([pa.array([], pa.string()), *forms])))


# Grading

GRADED = "struct<status:string,strict:boolean,contract:boolean,repairs:array<string>,precision:double,recall:double,missing:array<string>,extra:array<string>,duplicates:int>"


def _result(status: Column, strict: Column, contract: Column, **more: Column) -> Column:
    none = {"repairs": F.array().cast("array<string>"), "precision": F.lit(None), "recall": F.lit(None), "missing": F.array().cast("array<string>"), "extra": F.array().cast("array<string>"), "duplicates": F.lit(0)}
    return F.struct(status.alias("status"), strict.alias("strict"), contract.alias("contract"), *[more.get(k, v).alias(k) for k, v in none.items()]).cast(GRADED)


def graded_answers(df: DataFrame, text: str, item: str, truncated: str | None = None, unique: bool = False, wording: Wording = Wording()) -> DataFrame:
    """Add ``graded`` to rows of an answer and its item (a JSON text).

    The item has answer_type (scalar, set, top_k) and gold_value, a value, a list, or {columns, rows}; attribute, company and
    target_columns where they apply. ``strict``: right under the contract without repair; ``contract``: the text is one
    JSON value of the right type. ``unique``: by the final contract a set that names a value twice is neither.
    Items of several parts: ``graded_parts``.
    """
    no = F.lit(False)
    x = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), trimmed(F.col(text)).alias("text"), degenerate_status(F.col(text), F.col(truncated) if truncated else None).alias("stop"), F.parse_json(item).alias("item"))
    of = lambda path, kind="string": F.try_variant_get("item", path, kind)
    x = x.select("row", "text", "stop", of("$.answer_type").alias("kind"), of("$.attribute").alias("attribute"), F.coalesce(of("$.company"), F.lit("")).alias("entity"), of("$.target_columns", "array<string>").alias("targets"), of("$.gold_value", "variant").alias("gold"), of("$.gold_value.columns", "array<string>").alias("columns"), F.transform(of("$.gold_value.rows", "array<variant>"), as_list).alias("gold_rows"))
    known = F.when(F.col("kind").isin("scalar", "set", "top_k"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no grading of one "), F.coalesce("kind", F.lit("null")))))
    tabular = (F.col("kind") == "top_k") | ((F.col("kind") == "set") & F.coalesce(F.size("columns") > 1, no))
    x = x.withColumns({"kind": known, "tabular": tabular, "body": unfenced(F.col("text"))}).withColumns({"doc": whole_json(F.when(F.col("tabular"), F.col("text")).otherwise(F.col("body")))})

    # The value: of an object with one entry, that entry's (if its key was asked for).
    entries = as_map(F.col("doc"))
    x = x.withColumns({"key": F.when(F.size(entries) == 1, F.map_keys(entries)[0]), "value": F.when(F.size(entries) == 1, F.map_values(entries)[0]).otherwise(F.col("doc")), "decoded": F.col("doc").isNotNull()})
    words = _without(F.col("body"), wording, F.col("entity"))
    member = lambda v: F.struct(as_text(v).alias("text"), is_string(v).alias("quoted"))
    word = lambda t: F.struct(t.alias("text"), F.lit(True).alias("quoted"))
    cells = F.transform(as_list(F.col("value")), as_list)
    read = F.when(F.col("tabular"), F.transform(F.flatten(cells), member)).when(F.col("kind") == "set", F.when(F.col("decoded"), F.transform(as_list(F.col("value")), member)).otherwise(F.transform(listed_words(words, wording.nothing), word)))
    one = F.when(F.col("decoded"), F.array(member(F.col("value")))).otherwise(F.array(word(_of_sentence(words, wording, F.col("attribute"), F.col("entity")))))
    gold_plain = F.when(F.col("gold_rows").isNotNull(), F.transform("gold_rows", lambda r: as_text(r[0]))).when(F.col("kind") == "set", F.transform(as_list(F.col("gold")), as_text)).otherwise(F.array(as_text(F.col("gold"))))
    width = F.size("columns")
    x = x.withColumns({
        "members": F.when(F.col("kind") == "scalar", one).otherwise(read),
        "fits": F.when(F.col("tabular"), is_list(F.col("value")) & F.col("key").isNull() & F.forall(cells, lambda r: F.coalesce((F.size(r) == width) & ~F.exists(r, lambda c: F.coalesce(F.schema_of_variant(c).rlike("^(ARRAY|OBJECT)"), no)), no)))
        .when(~F.col("decoded"), F.lit(True)).when(F.col("kind") == "set", is_list(F.col("value"))).otherwise(is_plain(F.col("value"))),
        "wanted": F.when(F.col("tabular"), F.flatten(F.transform("gold_rows", lambda r: F.transform(r, as_text)))).when(F.col("kind") == "scalar", F.slice(gold_plain, 1, 1)).otherwise(gold_plain),
    })
    x = x.withColumn("mended", F.transform("members", lambda m: F.when(m["quoted"], unquoted(m["text"], F.col("decoded"))).otherwise(m["text"])))
    names = F.concat(F.array("key"), F.array("attribute"), F.coalesce("targets", F.array().cast("array<string>")))
    x = x.withColumn("f", answer_forms(F.array("wanted", F.transform("members", lambda m: m["text"]), "mended", names)))
    x = x.withColumns({"want": F.col("f")[0], "given": F.col("f")[1], "better": F.col("f")[2], "opened": F.coalesce(F.array_contains(F.array_compact(F.slice(F.col("f")[3], F.lit(2), F.size(F.col("f")[3]))), F.col("f")[3][0]), no), "contract": contract_column(F.col("text"), F.col("kind"))})

    # Rows of rows: each row a text of its own, in order or as a set.
    rows = lambda flat: F.when(F.size(flat) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1), lambda i: F.to_json(F.slice(flat, i * width + 1, width))))
    alike = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    x = x.withColumns({"got_rows": F.when(F.col("tabular") & F.col("fits"), rows(F.col("given"))), "want_rows": F.when(F.col("tabular"), rows(F.col("want")))})
    same = F.when(F.col("kind") == "top_k", F.col("got_rows") == F.col("want_rows")).otherwise(alike("got_rows", "want_rows"))
    twice = F.size("got_rows") - F.size(F.array_distinct("got_rows"))
    clean = ~((F.col("kind") == "set") & (twice > 0)) if unique else F.lit(True)
    verdict = lambda ok: F.when(ok, "correct").otherwise("incorrect")
    table = F.when(~F.col("decoded"), _result(F.lit("parse_failure"), no, no)).when(~F.col("fits"), _result(F.lit("incorrect"), no, no)).otherwise(_result(verdict(same), same & clean, clean, duplicates=twice))

    # Values: as they were given if that is right, else as they are after the repairs.
    shut = F.col("key").isNotNull() & ~F.col("opened")
    repairs = F.array_compact(F.array(F.when(F.col("opened"), UNWRAPPED), F.when(F.coalesce(~shut & F.exists(F.arrays_zip(F.transform("members", lambda m: m["text"]).alias("a"), F.col("mended").alias("b")), lambda z: z["a"] != z["b"]), no), UNQUOTED)))
    exact = ~F.col("opened") & ~shut & F.col("fits") & alike("given", "want")
    mended = ~shut & F.col("fits") & alike("better", "want")
    right = exact | mended
    got = F.array_distinct(F.when(exact, F.col("given")).otherwise(F.col("better")))
    want = F.array_distinct("want")
    hits = F.size(F.array_intersect(got, want))
    share = lambda n, other: F.when(F.size(n) > 0, hits / F.size(n)).otherwise((F.size(other) == 0).cast("double"))
    again = F.size("given") - F.size(F.array_distinct("given")) if unique else F.lit(0)
    strict = F.col("contract") & exact & (F.size(repairs) == 0)
    whole = F.when(F.col("body").isNull(), _result(F.lit("parse_failure"), no, F.col("contract"))).when(
        (F.col("kind") == "set") & (shut | ~F.col("fits") | F.col("want").isNull()), _result(F.lit("parse_failure"), no, F.col("contract"), repairs=F.when(F.col("opened"), F.array(F.lit(UNWRAPPED))).otherwise(F.array().cast("array<string>")))
    ).when(F.col("kind") == "set", _result(verdict(right), strict & (again == 0), F.col("contract") & (again == 0), repairs=repairs, precision=share(got, want), recall=share(want, got), missing=F.array_sort(F.array_except(want, got)), extra=F.array_sort(F.array_except(got, want)), duplicates=again))
    whole = whole.otherwise(_result(verdict(F.coalesce(right, no)), F.coalesce(strict, no), F.col("contract"), repairs=repairs))
    graded = F.when(F.col("stop").isNotNull(), _result(F.col("stop"), no, no)).when(F.col("tabular"), table).otherwise(whole)
    return x.select("row.*", graded.alias("graded"))


def graded_parts(df: DataFrame, key: str, text: str, item: str, truncated: str | None = None, unique: bool = False, wording: Wording = Wording()) -> DataFrame:
    """(key, status, strict, contract, parts): answers to items of several parts, one object with exactly the declared part ids.

    Each part is a row that is graded by its own type; all must be right. ``key`` is one value a row. Parts and gold that disagree are an error.
    """
    x = dealt(df, key).select(F.col(key).alias("key"), trimmed(F.col(text)).alias("text"), degenerate_status(F.col(text), F.col(truncated) if truncated else None).alias("stop"), F.parse_json(item).alias("item"))
    x = x.withColumns({"parts": F.try_variant_get("item", "$.parts", "array<variant>"), "gold": F.try_variant_get("item", "$.gold_value", "map<string,variant>"), "said": as_map(whole_json(F.col("text")))})
    x = x.withColumn("ids", F.transform("parts", lambda p: F.try_variant_get(p, "$.part_id", "string")))
    same = lambda a, b: F.coalesce((F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0), F.lit(False))
    sound = (F.size("ids") > 0) & same(F.col("ids"), F.array_distinct("ids")) & same(F.col("ids"), F.map_keys("gold"))
    x = x.withColumn("ids", F.when(sound, F.col("ids")).otherwise(F.raise_error(F.lit("gold and part ids must agree"))))
    early = F.when(F.col("stop").isNotNull(), F.col("stop")).when(whole_json(F.col("text")).isNull(), "parse_failure").when(~same(F.map_keys("said"), F.col("ids")), "incorrect")
    x = x.withColumn("early", early)
    joined = lambda p, g: F.concat(F.regexp_replace(F.to_json(p), r"\}\z", ""), F.lit(', "gold_value": '), F.to_json(g), F.lit("}"))
    one = F.transform("parts", lambda p, i: F.struct(i.alias("i"), F.col("ids")[i].alias("id"), F.to_json(F.col("said")[F.col("ids")[i]]).alias("text"), joined(p, F.col("gold")[F.col("ids")[i]]).alias("item")))
    units = x.where(F.col("early").isNull()).select("key", F.inline(one))
    done = graded_answers(units, "text", "item", unique=unique, wording=wording).groupBy("key").agg(
        F.bool_and(F.col("graded.status") == "correct").alias("right"), F.bool_and("graded.strict").alias("strict"), F.bool_and("graded.contract").alias("contract"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "id", "graded.status"))), lambda p: F.struct(p["id"].alias("part_id"), p["status"].alias("status"))).alias("parts"),
    )
    out = x.select("key", "early").join(done, "key", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(F.col("key").alias(key), F.coalesce("early", F.when(F.col("right"), "correct").otherwise("incorrect")).alias("status"), no(F.col("strict")).alias("strict"), no(F.col("contract")).alias("contract"), "parts")


def duplicates(values: Column) -> Column:
    """How many members of an array repeat an earlier one."""
    return F.size(values) - F.size(F.array_distinct(values))


def contract_prompt(item: dict) -> str:
    """The output contract of an item in words; parts by their own."""
    kind, target = item.get("answer_type"), json.dumps(item.get("target_columns", []))
    if kind == "multi_part":
        parts = item.get("parts") or []
        if not parts or len({p["part_id"] for p in parts}) != len(parts):
            raise ValueError("parts need ids of their own")
        return "Answer with one JSON object that has exactly these parts, each by its own rule: " + json.dumps({p["part_id"]: contract_prompt(p) for p in parts}, ensure_ascii=False)
    if kind == "scalar":
        return "Answer with one JSON string or number, the recorded value, and nothing else."
    if kind == "top_k":
        return f"Answer with one JSON array of rows in the order asked for, their columns in the order {target}, and nothing else."
    if kind == "set" and len(item.get("target_columns", [])) > 1:
        return f"Answer with one JSON array of rows, none twice, their columns in the order {target}, and nothing else; [] if no record matches."
    if kind == "set":
        return "Answer with one JSON array of all values asked for, each once, and nothing else; [] if no record matches."
    raise ValueError(f"no contract for {kind!r}")
