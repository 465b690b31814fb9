"""Prompts, model calls and parsing of verdicts, each as a job over a table of examples.

Model functions come from the caller: fn(list of prompts, temperature, max_tokens) -> list of responses. They run in batches on the workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import strip
from evalloom.sources.tables import done_with

_ANSWER = 'Give a JSON object {"%s": %s, "reasoning": "why"}.'
#: Default templates; callers give their own.
TEMPLATES = {
    "correctness": "Is the model answer correct, compared to the reference answer? Compare meaning, not wording.\n\nQuery: {query}\n\nModel Answer: {model_answer}\n\nReference Answer: {reference_answer}\n\n" + _ANSWER % ("correctness_binary", "true or false"),
    "hallucination": "Does the model answer make claims that the retrieved context does not support?\n\nRetrieved Context:\n{retrieved_context}\n\nModel Answer:\n{model_answer}\n\n" + _ANSWER % ("hallucination_binary", "true or false"),
    "risk_direction": "Does the model answer overestimate costs (-1, care avoidance), underestimate them (1, unexpected cost), or neither (0)?\n\nModel Answer:\n{model_answer}\n\nRetrieved Context:\n{retrieved_context}\n\n" + _ANSWER % ("risk_direction", "-1, 0 or 1"),
    "risk_impact": "How much does the difference of costs matter, from 0 (not at all) to 3 (severely)?\n\nModel Answer Cost:\n{model_answer_cost}\n\nActual Cost:\n{actual_cost}\n\n" + _ANSWER % ("risk_impact", "0, 1, 2 or 3"),
    "cost": 'Extract the costs that the text states.\n\nText:\n{text}\n\nGive a JSON object {"money": text or null, "time": text or null, "steps": text or null, "reasoning": "what was found"}.',
}
REQUIRED = {k: re.findall(r"\{(\w+)\}", t) for k, t in TEMPLATES.items()}
#: Phrases of failure modes, in order of precedence, and their names.
FAILURE_MODES = (
    ("cost misstatement", "Cost Misstatement"), ("omitted deductible", "Omitted Deductible"), ("incorrect copay", "Incorrect Copay"), ("wrong coverage", "Wrong Coverage"), ("missing information", "Missing Information"),
    ("hallucination", "Hallucination"), ("incorrect cost", "Incorrect Cost"), ("premium error", "Premium Error"), ("coinsurance mistake", "Coinsurance Mistake"), ("out-of-pocket error", "Out-Of-Pocket Error"),
)


def render_prompt(df: DataFrame, template: str, mapping: Mapping[str, str], required: list[str] | None = None, out: str = "prompt") -> DataFrame:
    """df with the prompt: the template's {placeholders} replaced in one pass, so that no value is expanded again. mapping: placeholder -> column."""
    named = re.findall(r"\{(\w+)\}", template)
    if missing := [p for p in (required or list(mapping)) if p not in named]:
        raise ValueError(f"the template lacks {', '.join(missing)}")
    parts = re.split(r"\{(" + "|".join(map(re.escape, mapping)) + r")\}", template)
    return df.withColumn(out, F.concat(*(F.coalesce(F.col(mapping[p]).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts))))


def rag_prompt(question: Column, context: Column, refuse: bool = True, template: str | None = None) -> Column:
    """context: array of texts; empty or null: the bare question. template: other wording, with {context} and {question}."""
    if template is not None:
        texts = {"context": F.array_join(F.coalesce(context, F.array().cast("array<string>")), "\n\n"), "question": F.coalesce(question, F.lit(""))}
        return F.concat(*(texts[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(context|question)\}", template))))
    say = ' If the answer cannot be found in the context, say "I cannot answer this question based on the provided context."' if refuse else ""
    full = F.concat(F.lit("Context information:\n"), F.array_join(context, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer the question based on the context provided above." + say + "\n\nAnswer:"))
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, full).otherwise(F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer:")))


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


#: What a context is introduced by, the answer when it holds none, and the line that stands for no context.
CONTEXT_SAYS = "Use the following context to answer the user's question:\n\n"
NO_CONTEXT = "[No retrieved context available]"


def chat_messages(question: Column, context: Column, history: Column, says: str = CONTEXT_SAYS) -> Column:
    """History, then the context as a system message (if there is any), then the question."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    system = F.array(message("system", F.concat(F.lit(says), F.array_join(context, "\n\n"))))
    return F.concat(F.coalesce(history, none), F.when(F.coalesce(F.size(context), F.lit(0)) > 0, system).otherwise(none), F.array(message("user", question)))


def messages_to_prompt(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


#: What a call gives, and the end of the name of the column that holds it until it is taken apart.
ANSWER, ANSWERED = ["response", "error", "begun", "ended"], "__answered"


def _model(fn: Callable[[list[str], float, int], list[str]], temperature: float, max_tokens: int, batch_size: int) -> Callable[[Column], Column]:
    """From prompts to structs of ANSWER; see `call_model`."""
    kinds = [pa.string(), pa.string(), *[pa.timestamp("us", "UTC")] * 2]

    def now() -> pd.Timestamp:
        return pd.Timestamp.now("UTC")

    def one(text: str) -> tuple:
        begun = now()
        try:
            (answer,) = fn([text], temperature, max_tokens)
            return answer, None, begun, now()
        except Exception as e:  # noqa: BLE001  the model's errors are data
            return None, f"{type(e).__name__}: {e}", begun, now()

    def several(texts: list[str]) -> list[tuple]:
        begun = now()
        try:
            answers = list(fn(texts, temperature, max_tokens)) if texts else []
        except Exception:  # noqa: BLE001
            answers = None
        if answers is None or len(answers) != len(texts):
            return [one(t) for t in texts]
        ended = now()
        return [(x, None, begun, ended) for x in answers]

    def run(batch: pa.Array) -> pa.Array:
        parts = []
        for a in range(0, len(batch), batch_size):
            texts = batch.slice(a, batch_size).to_pylist()
            got = iter(several([t for t in texts if t is not None]))
            rows = [(None,) * 4 if t is None else next(got) for t in texts]
            parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=ANSWER))
        return pa.concat_arrays(parts or [pa.array([], pa.struct(list(zip(ANSWER, kinds, strict=True))))])

    # not deterministic, so that no filter or second use asks again
    return F.arrow_udf(run, "response string, error string, begun timestamp, ended timestamp").asNondeterministic()


def call_models(df: DataFrame, fn: Callable[[list[str], float, int], list[str]], prompts: Sequence[str], temperature: float = 0.1, max_tokens: int = 500, batch_size: int = 32) -> DataFrame:
    """df with a struct of ANSWER, <prompt>__answered, for each of the columns of prompts, as `call_model` asks them, in one pass over the rows.

    Prompts alone go to Python, and other columns stay where they are; a task has one Python process, however many prompts a row has."""
    asked = _model(fn, temperature, max_tokens, batch_size)
    return df.select(*(F.col(f"`{c}`") for c in df.columns), *(asked(F.col(p).cast("string")).alias(p + ANSWERED) for p in prompts))


def call_model(df: DataFrame, fn: Callable[[list[str], float, int], list[str]], prompt: str = "prompt", temperature: float = 0.1, max_tokens: int = 500, batch_size: int = 32, out: str = "response", times: tuple[str, str] | None = None) -> DataFrame:
    """df with response and error; a failing batch, or one with another number of answers than prompts, is tried prompt by prompt, so that an error
    stays with its row. A null prompt is not sent. times: names of columns for when a row's call began and ended (a batch's rows share both).

    Write the result before it is read more than once, or the model is called again."""
    names = [out, "error", *(times or ())]
    base = df.drop(*names)
    rows = call_models(base, fn, [prompt], temperature, max_tokens, batch_size)
    return rows.select(*(F.col(f"`{c}`") for c in base.columns), *(F.col(prompt + ANSWERED)[f].alias(n) for f, n in zip(ANSWER, names, strict=False)))


def generation_stats(df: DataFrame, column: str = "response", by: list[str] | None = None) -> DataFrame:
    n = F.length(column)
    return df.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"), F.coalesce(F.min(n), F.lit(0)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"))


def unfenced(c: Column) -> Column:
    """Without white space, an opening fence (with json or not) and a closing one."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(json)?", ""), r"```$", ""))


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def parse_response(df: DataFrame, schema: str, column: str = "response", out: str = "parsed") -> DataFrame:
    """df with the struct `out` and parse_error: blank, or no JSON object."""
    body = unfenced(F.col(column))
    error = F.when(F.coalesce(body, F.lit("")) == "", "empty response").when(~is_object(body), "not a JSON object")
    return df.withColumn("parse_error", error).withColumn(out, F.when(error.isNull(), F.from_json(body, schema)))


STAGES = {"correctness": ("correctness_binary", "boolean"), "hallucination": ("hallucination_binary", "boolean"), "risk_direction": ("risk_direction", "int"), "risk_impact": ("risk_impact", "double")}


def validate_verdict(df: DataFrame, stage: str, column: str = "response") -> DataFrame:
    """df with value, reasoning and verdict_error of a stage. A direction is -1, 0 or 1; an impact is truncated and 0 to 3."""
    field, kind = STAGES[stage]
    out = parse_response(df, f"{field} {kind}, reasoning string", column, "_p")
    value = F.col(f"_p.{field}")
    if stage == "risk_direction":
        value = F.when(value.isin(-1, 0, 1), value)
    if stage == "risk_impact":
        whole = value.cast("int")
        value = F.when(whole.between(0, 3), whole)
    error = F.coalesce(F.col("parse_error"), F.when(value.isNull(), f"missing or invalid {field}"))
    reasoning = F.when(error.isNull(), F.coalesce(F.col("_p.reasoning"), F.lit("No reasoning provided")))
    return out.withColumn("verdict_error", error).withColumn("value", value).withColumn("reasoning", reasoning).drop("_p", "parse_error")


def cost_result(df: DataFrame, column: str = "response", out: str = "cost") -> DataFrame:
    """df with the struct money, time, steps, reasoning; cost_error if the reasoning is missing or the response is no object."""
    got = parse_response(df, "money string, time string, steps string, reasoning string", column, out)
    error = F.coalesce(F.col("parse_error"), F.when(F.col(f"{out}.reasoning").isNull(), "missing reasoning"))
    return got.withColumn("cost_error", error).withColumn(out, F.when(error.isNull(), F.col(out))).drop("parse_error")


def has_cost(c: Column) -> Column:
    return F.coalesce(c["money"], c["time"], c["steps"]).isNotNull()


def cost_gate(model: Column, actual: Column) -> Column:
    """Why the impact is not judged; null if it is."""
    return F.when(~has_cost(model), "No costs found in model answer").when(~has_cost(actual), "No costs found in retrieved context")


def cost_json(c: Column) -> Column:
    return F.to_json(F.struct(c["money"].alias("money"), c["time"].alias("time"), c["steps"].alias("steps")))


def _bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def reasoning_trace(correct: Column, hallucination: Column, direction: Column, impact: Column, correct_why: Column, hallucination_why: Column, cost_why: Column, impact_why: Column) -> Column:
    kind = F.when(direction == -1, "care avoidance risk (-1)").when(direction == 0, "no clear direction (0)").otherwise("unexpected cost risk (+1)")
    some = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat_ws("\n\n", F.concat(F.lit("Correctness Analysis: "), some(correct_why)), F.concat(F.lit("Correctness Result: "), _bool(correct)), F.concat(F.lit("Hallucination Analysis: "), some(hallucination_why)), F.concat(F.lit("Hallucination Result: "), _bool(hallucination)),
        F.when(direction.isNotNull(), F.concat(F.lit("Risk Direction Analysis: "), some(cost_why))), F.when(direction.isNotNull(), F.concat(F.lit("Risk Direction Result: "), kind)),
        F.when(impact.isNotNull(), F.concat(F.lit("Risk Impact Analysis: "), some(impact_why))), F.when(impact.isNotNull(), F.concat(F.lit("Risk Impact Result: "), impact.cast("string"))))


def short_reasoning(correct: Column, hallucination: Column, direction: Column, impact: Column) -> Column:
    kind = F.when(direction == -1, "care avoidance risk").when(direction == 0, "no clear risk direction").when(direction == 1, "unexpected cost risk").otherwise("unknown")
    parts = F.concat_ws("; ", F.when(correct, "Answer is correct").otherwise("Answer is incorrect"), F.when(hallucination, "hallucination detected").otherwise("no hallucination detected"), F.when(direction.isNotNull(), F.concat(F.lit("risk direction: "), kind)), F.when(impact.isNotNull(), F.concat(F.lit("risk impact: "), impact.cast("string"))))
    return F.concat(parts, F.lit("."))


def failure_mode(reasoning: Column, compat: bool = False) -> Column:
    """The first phrase of FAILURE_MODES that the reasonings (without labels) hold; null without one.

    compat: as if the labels of `reasoning_trace` stood among them, so that "hallucination" always holds: what comes after it is never given, nor is null."""
    if compat:
        reasoning = F.concat(F.lit("Hallucination Analysis: "), F.coalesce(reasoning, F.lit("")))
    out = F.lit(None).cast("string")
    for phrase, name in reversed(FAILURE_MODES):
        out = F.when(F.contains(F.lower(reasoning), F.lit(phrase)), name).otherwise(out)
    return out


def keyword_verdict(c: Column, kind: str, compat: bool = False) -> Column:
    """A verdict by words of free text. binary: compat lets "incorrect" count as "correct", else negatives are asked first, as whole words."""
    t = F.lower(c)
    has = lambda *words: t.rlike("|".join(re.escape(w) for w in words))
    if kind == "binary":
        if compat:
            return F.coalesce(has("yes", "true", "correct", "accurate"), F.lit(False))
        no, yes = r"(^|[^a-z])(no|not|false|incorrect|inaccurate)([^a-z]|$)", r"(^|[^a-z])(yes|true|correct|accurate)([^a-z]|$)"
        return F.when(t.rlike(no), False).otherwise(F.coalesce(t.rlike(yes), F.lit(False)))
    if kind == "direction":
        return F.when(has("care avoidance", "overestimate", "-1"), -1).when(has("unexpected cost", "underestimate", "1"), 1).when(has("no clear", "neutral", "0"), 0)
    if kind == "impact":
        return F.when(has("3", "severe", "high"), 3).when(has("2", "moderate", "medium"), 2).when(has("1", "mild", "low"), 1).when(has("0", "none", "minimal"), 0)
    raise ValueError("kind is binary, direction or impact")


#: Default prompts of the judge whose answers are read by keywords; callers give their own.
KEYWORD_TEMPLATES = {
    "correctness": "Question: {question}\n\nReference answer: {reference_answer}\n\nGiven answer: {generated_answer}\n\nDoes the given answer say the same as the reference? Answer yes or no.",
    "hallucination": "Context:\n{context}\n\nGiven answer: {generated_answer}\n\nDoes the given answer claim anything that the context does not support? Answer yes or no.",
    "risk_direction": "Question: {question}\n\nContext:\n{context}\n\nGiven answer: {generated_answer}\n\nWhat do the costs in the given answer lead to: care avoidance, unexpected cost, or no clear direction?",
    "risk_impact": "Question: {question}\n\nContext:\n{context}\n\nGiven answer: {generated_answer}\n\nHow much does that matter: none, mild, moderate or severe?",
}
KEYWORD_KINDS = {"correctness": "binary", "hallucination": "binary", "risk_direction": "direction", "risk_impact": "impact"}


def keyword_judge(df: DataFrame, fn: Callable, stage: str, templates: Mapping[str, str] = KEYWORD_TEMPLATES, compat: bool = False, call: Callable = call_model) -> DataFrame:
    """df (question, reference_answer, generated_answer, context) with <stage> and <stage>_error: prompt, call, verdict by keywords of the answer.

    context: a text, or an array of texts."""
    if dict(df.dtypes).get("context", "").startswith("array"):
        df = df.withColumn("_context", F.array_join("context", "\n\n"))
    else:
        df = df.withColumn("_context", F.col("context") if "context" in df.columns else F.lit(""))
    mapping = {p: "_context" if p == "context" else p for p in re.findall(r"\{(\w+)\}", templates[stage])}
    asked = call(render_prompt(df, templates[stage], mapping, None, "_prompt"), fn, "_prompt", out="_response")
    value = F.when(F.col("error").isNull(), keyword_verdict(F.col("_response"), KEYWORD_KINDS[stage], compat))
    return asked.withColumns({stage: value, f"{stage}_error": F.col("error")}).drop("_context", "_prompt", "_response", "error")


def _verdict(asked: DataFrame, stage: str) -> DataFrame:
    """The verdict's columns in place of _response, error, _begun and <stage>_ended; see `judge_stage`."""
    got = validate_verdict(asked, stage, "_response")
    failed = F.coalesce(F.col("error"), F.col("verdict_error"))
    return got.withColumns({stage: F.col("value"), f"{stage}_reasoning": F.col("reasoning"), f"{stage}_error": failed}).drop("_response", "_begun", "error", "verdict_error", "value", "reasoning")


def _cost(asked: DataFrame, name: str) -> DataFrame:
    """A cost and its error in place of _response and error."""
    failed = F.coalesce(F.col("error"), F.col("cost_error"))
    return cost_result(asked, "_response", name).withColumn(f"{name}_error", failed).drop("_response", "cost_error", "error", "_begun", f"{name}_ended")


def judge_stage(df: DataFrame, fn: Callable, stage: str, mapping: Mapping[str, str], templates: Mapping[str, str] = TEMPLATES, call: Callable = call_model) -> DataFrame:
    """df with <stage>, <stage>_reasoning, <stage>_error and <stage>_ended (when the model had answered), by prompt, call, parse and validation."""
    asked = call(render_prompt(df, templates[stage], mapping, REQUIRED[stage], "_prompt"), fn, "_prompt", out="_response", times=("_begun", f"{stage}_ended"))
    return _verdict(asked.drop("_prompt"), stage)


#: What the prompts of `judge` are made of: for each name, its template and the columns of the template's placeholders.
ASKED = {
    "correctness": ("correctness", {"query": "question", "model_answer": "model_answer", "reference_answer": "reference_answer"}),
    "hallucination": ("hallucination", {"retrieved_context": "context", "model_answer": "model_answer"}),
    "risk_direction": ("risk_direction", {"model_answer": "model_answer", "retrieved_context": "context"}),
    "model_cost": ("cost", {"text": "model_answer"}),
    "actual_cost": ("cost", {"text": "context"}),
}


def _asked(df: DataFrame, fn: Callable, names: Sequence[str], drop: Sequence[str], keep: Callable[[DataFrame], DataFrame], templates: Mapping[str, str], call: Callable) -> DataFrame:
    """df, less the columns to drop, with the verdicts or costs of these names, written. A plain call asks all of them in one pass, so that texts are read and written once; a ledger's
    looks through its rows by itself, so each of its calls gets written rows."""
    parsed = lambda rows, n: _verdict(rows, n) if n in STAGES else _cost(rows, n)
    prompt = lambda rows, n: render_prompt(rows, templates[ASKED[n][0]], ASKED[n][1], list(ASKED[n][1]), f"_prompt_{n}")
    if call is not call_model:
        for n in names:
            got = parsed(call(prompt(df, n), fn, f"_prompt_{n}", out="_response", times=("_begun", f"{n}_ended")).drop(f"_prompt_{n}"), n)
            before, df = df, keep(got.drop(*drop) if n == names[-1] else got)
            if n != names[0]:
                done_with(before)
        return df
    rows = df
    for n in names:
        rows = prompt(rows, n)
    rows = call_models(rows, fn, [f"_prompt_{n}" for n in names]).drop(*(f"_prompt_{n}" for n in names), *drop)
    for n in names:
        answer = F.col(f"_prompt_{n}{ANSWERED}")
        rows = parsed(rows.withColumns({c: answer[f] for c, f in zip(("_response", "error", "_begun", f"{n}_ended"), ANSWER, strict=True)}), n)
    return keep(rows.drop(*(f"_prompt_{n}{ANSWERED}" for n in names)))


def judge(df: DataFrame, fn: Callable, keep: Callable[[DataFrame], DataFrame], templates: Mapping[str, str] = TEMPLATES, gate: str = "correct", call: Callable = call_model) -> DataFrame:
    """df (example_id, question, model_answer, reference_answer, context) with all verdicts.

    Correctness and hallucination always; direction and impact only where the gate holds: correct, or hallucination. The gated stages run on the
    rows that pass alone. keep(df) writes a stage and gives it back, so that no model is called twice. call: `call_model`, or the `call` of a ledger."""
    if gate not in ("correct", "hallucination"):
        raise ValueError("gate is correct or hallucination")
    out = _asked(df, fn, ["correctness", "hallucination"], [], keep, templates, call)
    through = F.col("correctness") if gate == "correct" else F.col("hallucination")
    own = [c for c in out.columns if c != "example_id"]  # no text is needed any more
    risky = _asked(out.filter(through), fn, ["risk_direction", "model_cost", "actual_cost"], own, keep, templates, call)
    # a call that failed is an error, and not a text without costs
    risky = risky.withColumn("_failed", F.coalesce("model_cost_error", "actual_cost_error"))
    why = F.when(F.col("_failed").isNull(), cost_gate(F.col("model_cost"), F.col("actual_cost")))
    risky = risky.withColumn("_why", why).withColumns({"_a": cost_json(F.col("model_cost")), "_b": cost_json(F.col("actual_cost"))})
    impact = judge_stage(risky.filter("_why is null and _failed is null"), fn, "risk_impact", {"model_answer_cost": "_a", "actual_cost": "_b"}, templates, call).select("example_id", "risk_impact", "risk_impact_reasoning", "risk_impact_error", "risk_impact_ended")
    risky = risky.join(keep(impact), "example_id", "left").withColumn("risk_impact_reasoning", F.coalesce("risk_impact_reasoning", "_why"))
    more = ["risk_direction", "risk_direction_reasoning", "risk_direction_error", "model_cost", "actual_cost", "model_cost_error", "actual_cost_error", "risk_impact", "risk_impact_reasoning", "risk_impact_error", "risk_direction_ended", "risk_impact_ended"]
    out = out.join(risky.select("example_id", *more), "example_id", "left")
    reasons = F.concat_ws(" ", *(f"{s}_reasoning" for s in STAGES))
    out = out.withColumn("judged_at", F.greatest(*(f"{s}_ended" for s in STAGES))).drop(*(f"{s}_ended" for s in STAGES))
    errors = [f"{s}_error" for s in STAGES][:3] + ["model_cost_error", "actual_cost_error", "risk_impact_error"]
    return out.withColumn("failure_mode", failure_mode(reasons)).withColumn("judge_error", F.coalesce(*errors))
