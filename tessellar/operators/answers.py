"""Intents repaired from a model's raw output, passages for a prompt, citations, and what is told without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, safety
from ..functions import text as text_of

MARK = r"\[([0-9]{1,2})\]"
_SLOTS = "map<string,string>"


def json_object(raw: Column) -> Column:
    """The fields of the JSON object in a model's output, as a map of strings; null if there is none.

    Code fences go, the text from the first brace to the last counts, and single quotes are taken for double ones if it is no JSON otherwise.
    """
    bare = F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?\s*|\s*```$", "")
    block = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    sound = lambda t: F.try_parse_json(t).isNotNull()
    parse = lambda t: F.from_json(t, "map<string,string>")
    return text_of.bound(block, lambda b: F.when(sound(b), parse(b)).when(sound(F.replace(b, F.lit("'"), F.lit('"'))), parse(F.replace(b, F.lit("'"), F.lit('"')))))


def intent_name(value: Column) -> Column:
    """The intent meant: an exact name, else the first intent that is no action and holds the name or lies in it, else answer_question."""
    name = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    actions = list(fixed.ACTION_SCOPES)
    out = F.when(value.isNull(), "answer_question").when(name.isin(*fixed.INTENTS), name)
    for intent in fixed.INTENTS:
        if intent not in actions:
            out = out.when(F.lit(intent).contains(name) | name.contains(intent), intent)
    return out.otherwise("answer_question")


def clean_slots(slots: Column) -> Column:
    """The known slots with a value; a number keeps its digits, unless it is a placeholder, others at most 2,000 characters."""
    filled = F.map_filter(slots, lambda k, v: k.isin(*fixed.SLOT_KEYS) & v.isNotNull() & ~v.isin("", "[]"))

    def tidy(k: Column, v: Column) -> Column:
        t = F.trim(v)
        digits = F.regexp_replace(t, r"[^\p{Nd}]", "")
        number = F.when(safety.contains_placeholder(t) | (digits == ""), t).otherwise(digits)
        return F.when(k == "msisdn", number).otherwise(F.substring(t, 1, 2000))

    return F.coalesce(F.transform_values(filled, tidy), F.expr(f"cast(map() as {_SLOTS})"))


def asks_for_human(message: Column) -> Column:
    return message.rlike("(?iU)" + fixed.HANDOFF_ASKED)


def detect_intent(message: Column, raw: Column) -> Column:
    """struct(intent, confidence, slots) of a message and a model's raw output for it (null: the model failed).

    Blank messages are out of scope and an explicit wish for a human needs no model. An action below the least confidence becomes
    answer_question, with its slots.
    """
    of = lambda name, sure, slots=None: F.struct(name.alias("intent"), sure.cast("double").alias("confidence"), (F.expr(f"cast(map() as {_SLOTS})") if slots is None else slots).alias("slots"))
    safe = of(F.lit("answer_question"), F.lit(0.0))

    def repaired(fields: Column) -> Column:
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fields["confidence"].try_cast("double"), F.lit(0.0))))
        slots = clean_slots(F.from_json(fields["slots"], _SLOTS))
        low = lambda name: F.when(name.isin(*fixed.ACTION_SCOPES) & (sure < fixed.LEAST_ACTION), "answer_question").otherwise(name)
        return F.when(fields.isNull(), safe).otherwise(of(text_of.bound(intent_name(fields["intent"]), low), sure, slots))

    blank = F.coalesce(message, F.lit("")).rlike(r"(?U)^\s*$")
    return F.when(blank, of(F.lit("out_of_scope"), F.lit(1.0))).when(asks_for_human(message), of(F.lit("human_handoff"), F.lit(0.99))).otherwise(text_of.bound(json_object(raw), repaired))


# ---- passages and citations: `passages` is an array of struct(title, url, doc_name, page, text) in rank order --
def origin(p: Column, shared: str = "page") -> Column:
    """Where a passage comes from: an uploaded file and its page, or a title or URL behind the shared source's name."""
    filled = lambda c: F.nullif(c, F.lit(""))
    page = F.when(F.coalesce(p["page"], F.lit(0)) != 0, F.concat(F.lit(fixed.PAGE_OF), p["page"].cast("string"))).otherwise("")
    return F.when(filled(p["doc_name"]).isNotNull(), F.concat(F.lit(fixed.UPLOAD_ORIGIN), p["doc_name"], page)).otherwise(F.concat(F.lit(f"{shared}: "), F.coalesce(filled(p["title"]), p["url"], F.lit(""))))


def format_passages(passages: Column, shared: str = "page") -> Column:
    """Numbered blocks: [i] (origin), and the text below."""
    block = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), origin(p, shared), F.lit(")\n"), F.regexp_replace(p["text"], r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.transform(passages, block), "\n\n")


def extract_citations(answer: Column, passages: Column) -> Column:
    """struct(text, citations): the markers of passages that exist, numbered anew in the order of the passages, and what they cite.

    Markers of no passage vanish and runs of blanks shrink, but only if some marker is good; an answer without one stays as it is.
    """
    kind = "array<struct<marker:string,title:string,url:string,doc_name:string,page:int,snippet:string>>"
    found = F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda x: x.cast("int"))
    used = F.array_sort(F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= F.size(passages)))))

    def told(u: Column) -> Column:
        mark = lambda i: F.concat(F.lit("["), F.array_position(u, i).cast("string"), F.lit("]"))
        parts = F.split(answer, MARK, -1)
        put = lambda hits: F.array_join(F.transform(parts, lambda x, i: F.when((i < F.size(hits)) & F.array_contains(u, F.get(hits, i)), F.concat(x, mark(F.get(hits, i)))).otherwise(x)), "")
        clean = F.regexp_replace(F.regexp_replace(text_of.bound(found, put), r"[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")
        filled = lambda c: F.nullif(c, F.lit(""))

        def cite(i: Column) -> Column:
            p = F.get(passages, i - 1)
            name = F.coalesce(filled(p["title"]), filled(p["doc_name"]), filled(p["url"]), F.lit("Source"))
            return F.struct(mark(i).alias("marker"), name.alias("title"), p["url"].alias("url"), p["doc_name"].alias("doc_name"), p["page"].cast("int").alias("page"), text_of.snippet(p["text"]).alias("snippet"))

        none = F.struct(answer.alias("text"), F.expr(f"cast(array() as {kind})").alias("citations"))
        return F.when(F.size(u) == 0, none).otherwise(F.struct(clean.alias("text"), F.transform(u, cite).alias("citations")))

    return text_of.bound(used, told)


def extractive_answer(passages: Column, notice: Column, most: int = 3) -> Column:
    """struct(text, citations) told without a model: a notice and the first passages, quoted and cited."""
    shown = F.slice(passages, 1, most)
    quoted = F.transform(shown, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text_of.snippet(p["text"])))
    return extract_citations(F.array_join(F.concat(F.array(notice, F.lit("")), quoted), "\n"), shown)


def unmask_citations(citations: Column, mapping: Column) -> Column:
    """Title, snippet and file name of citations with their values back."""
    back = lambda c, f: F.when(c[f].isNotNull(), safety.unmask(c[f], mapping))
    return F.transform(citations, lambda c: c.withField("title", back(c, "title")).withField("snippet", back(c, "snippet")).withField("doc_name", back(c, "doc_name")))


def with_sources(text: Column, citations: Column, header: str = "Sources:") -> Column:
    """A text followed by the list of what it cites."""
    filled = lambda c: F.nullif(c, F.lit(""))

    def line(c: Column) -> Column:
        page = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(F.lit(" (p."), c["page"].cast("string"), F.lit(")"))).otherwise("")
        whole = F.concat(c["marker"], F.lit(" "), c["title"], F.lit(" — "), F.coalesce(filled(c["url"]), filled(c["doc_name"]), F.lit("")), page)
        return F.regexp_replace(whole, "[ —]+$", "")

    return F.when(F.size(citations) > 0, F.array_join(F.concat(F.array(text, F.lit(""), F.lit(header)), F.transform(citations, line)), "\n")).otherwise(text)


def answer(rows: DataFrame, generate: Callable[[Column], Column] | None, notices: dict[str, str], least: float = fixed.REFUSE_BELOW) -> DataFrame:
    """rows (question, passages, confidence, language) with `text`, `citations`, `grounded` and `resolution`.

    Without passages or below the least confidence the answer is refused and the model not asked. `generate` takes the prompt and
    gives the model's text, null where it fails; without a model, and where it fails, the first passages are quoted instead.
    `notices` has the keys no_context and model_down.
    """
    enough = (F.size("passages") > 0) & (F.coalesce("confidence", F.lit(0.0)) >= least)
    prompt = F.concat_ws("\n\n", F.lit("Passages"), format_passages(F.col("passages")), F.lit("Question"), F.col("question"), F.lit("Answer from the passages alone, with the numbers of those used in brackets."))
    raw = F.lit(None).cast("string") if generate is None else generate(F.when(enough, prompt))
    out = rows.withColumn("_raw", F.when(enough, raw))
    none = F.struct(F.lit(notices["no_context"]).alias("text"), F.expr("cast(array() as array<struct<marker:string,title:string,url:string,doc_name:string,page:int,snippet:string>>)").alias("citations"))
    silent = F.col("_raw").rlike(r"(?U)^\s*$")
    told = F.when(~enough | F.coalesce(silent, F.lit(False)), none).when(F.col("_raw").isNull(), extractive_answer(F.col("passages"), F.lit(notices["model_down"]))).otherwise(extract_citations(F.col("_raw"), F.col("passages")))
    out = out.withColumn("_told", told).withColumns({"text": F.col("_told.text"), "citations": F.col("_told.citations"), "grounded": F.size("_told.citations") > 0})
    return out.withColumn("resolution", F.when(~enough, "refused").when(F.col("grounded"), "answered").otherwise("no_answer")).drop("_raw", "_told")
