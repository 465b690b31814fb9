"""Queries of prompts, parsing, meta-evaluation and judge reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import judging as J
from evalloom.operators import metaeval as V

from .fixtures import COST, QA, RESPONSE, VERDICT, duck_rows, spark_rows, spread
from .text_queries import claims_sql, generic_sql, keywords_sql, normalize_sql, numeric_sql

TEMPLATE = "Question: {query}\nAnswer: {model_answer}\nReference: {reference_answer}\nSay {{\"correctness_binary\": true}} or false."


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def qa(s, d):
    return spark_rows(s, d, QA)


def costs(s, d):
    c = spark_rows(s, d, COST, spread)
    pair = lambda p: F.struct(F.col(f"{p}_money").alias("money"), F.col(f"{p}_time").alias("time"), F.col(f"{p}_steps").alias("steps"))
    return c.withColumns({"extracted_costs": pair("extracted"), "actual_costs": pair("actual")})


def render_prompts(s, d):
    template = TEMPLATE.replace("{{", "{").replace("}}", "}")
    return J.render_prompt(qa(s, d), template, {"query": "doc_id", "model_answer": "answer", "reference_answer": "reference"}).select("doc_id", "prompt")


def rag_prompt(s, d):
    context = F.when(F.col("doc_id") % 4 != 0, F.filter(F.array("context", "reference"), lambda x: x.isNotNull()))
    return qa(s, d).select("doc_id", J.rag_prompt(F.col("answer"), context).alias("prompt"))


def chat_prompt(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(listed.alias("t"))
    history = F.transform("t", lambda x: J.message(x["role"], x["text"]))
    context = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("first"), F.lit("second")))
    return rows.select("conv_id", J.messages_to_prompt(J.chat_messages(F.lit("what next?"), context, history)).alias("prompt"))


def parse_response(s, d):
    out = J.parse_response(spark_rows(s, d, RESPONSE), "correctness_binary boolean, reasoning string")
    return out.select("doc_id", F.col("parsed.correctness_binary").alias("verdict"), F.col("parsed.reasoning").alias("reasoning"), "parse_error")


def validate_verdict(s, d):
    rows, out = spark_rows(s, d, RESPONSE), None
    for stage, column in (("correctness", "response"), ("risk_direction", "direction_response"), ("risk_impact", "impact_response")):
        part = J.validate_verdict(rows, stage, column).select("doc_id", F.lit(stage).alias("stage"), F.col("value").cast("int").alias("value"), "reasoning", "verdict_error")
        out = part if out is None else out.unionByName(part)
    return out


def cost_rows(s, d):
    return J.cost_result(spark_rows(s, d, RESPONSE), "cost_response")


def cost_gate(s, d):
    none = F.struct(*(F.lit(None).cast("string").alias(k) for k in ("money", "time", "steps")))
    c = costs(s, d).withColumn("model", F.when(F.col("l_orderkey") % 60 != 0, F.col("extracted_costs")).otherwise(none)).withColumn("act", F.when(F.col("l_orderkey") % 7 != 0, F.col("actual_costs")).otherwise(none))
    return c.groupBy(J.cost_gate(F.col("model"), F.col("act")).alias("reason")).agg(F.count("*").alias("n"))


def _verdict_columns():
    return F.col("judged_correct"), F.col("l_orderkey") % 2 == 0, F.when(F.col("judged_correct"), F.col("judged_direction")), F.when(F.col("l_orderkey") % 3 == 0, F.col("judged_impact"))


def reasoning_trace(s, d):
    c, h, r, i = _verdict_columns()
    text = J.reasoning_trace(c, h, r, i, F.lit("same"), F.lit("grounded"), F.lit("cheaper"), F.lit("small"))
    return spark_rows(s, d, COST).groupBy(text.alias("trace")).agg(F.count("*").alias("n"))


def short_reasoning(s, d):
    return spark_rows(s, d, COST).groupBy(J.short_reasoning(*_verdict_columns()).alias("reasoning")).agg(F.count("*").alias("n"))


PHRASES = ["The answer has an Incorrect Copay.", "omitted deductible, and hallucination", "all good", "an OUT-OF-POCKET ERROR", "Hallucination found"]
FREE = ["Yes, it is.", "This is incorrect", "No", "care avoidance", "Unexpected cost (1)", "neutral", "severe", "low impact", "nothing", "2: moderate"]


def _spoken(s, d, texts):
    return s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int")).alias("t"))


def failure_mode(s, d):
    return _spoken(s, d, PHRASES).select("doc_id", J.failure_mode(F.col("t")).alias("mode"))


def keyword_verdict(s, d):
    t = F.col("t")
    return _spoken(s, d, FREE).select("doc_id", J.keyword_verdict(t, "binary").alias("verdict"), J.keyword_verdict(t, "binary", True).alias("verdict_compat"), J.keyword_verdict(t, "direction").alias("direction"), J.keyword_verdict(t, "impact").alias("impact"))


def stub(prompts, temperature, max_tokens):
    """A deterministic stand-in for a model."""
    out = []
    for p in prompts:
        n = len(p)
        kind = next((k for k in ("correctness_binary", "hallucination_binary", "risk_direction", "risk_impact", "money") if f'"{k}"' in p), "")
        value = {"correctness_binary": str(n % 3 != 0).lower(), "hallucination_binary": str(n % 5 == 0).lower(), "risk_direction": str(n % 3 - 1), "risk_impact": str(n % 4)}.get(kind)
        out.append(f'```json\n{{"{kind}": {value}, "reasoning": "stub"}}\n```' if value else '{"money": "$5", "reasoning": "stub"}')
    return out


def judged(s, d, gate="correct"):
    rows = qa(s, d).filter("context is not null").select(F.col("doc_id").alias("example_id"), F.lit("what?").alias("question"), F.col("answer").alias("model_answer"), F.col("reference").alias("reference_answer"), "context")
    from evalloom.sources.tables import kept

    out = J.judge(rows, stub, kept, gate=gate)
    return out.select("example_id", "correctness", "hallucination", "risk_direction", "risk_impact", "failure_mode", "judge_error")


def gt_correctness(s, d):
    return qa(s, d).select("doc_id", V.gt_correctness(F.col("answer"), F.col("reference")).alias("gt"))


def gt_hallucination(s, d):
    c = spark_rows(s, d, COST, spread)
    return c.groupBy("l_orderkey").agg(F.count_if(V.gt_hallucination(F.col("answer"), F.col("context"))).alias("unsupported"), F.count("*").alias("n"))


def gt_risk(fn, name):
    return lambda s, d: costs(s, d).groupBy("l_orderkey", fn(F.col("extracted_costs"), F.col("actual_costs")).alias(name)).agg(F.count("*").alias("n"))


def judged_costs(s, d):
    c = costs(s, d)
    return c.select("l_orderkey", F.col("answer").alias("model_answer"), F.col("context").alias("reference_answer"), "context", F.col("judged_correct").alias("correctness"), (F.col("l_orderkey") % 2 == 0).alias("hallucination"), F.col("judged_direction").alias("risk_direction"), F.col("judged_impact").alias("risk_impact"), "extracted_costs", "actual_costs")


def meta_eval(s, d):
    m = V.meta_evaluate(judged_costs(s, d), with_costs=True).select("l_orderkey", "meta_eval_output.*")
    return m.groupBy("explanation", "judge_correct", "ground_truth_correctness", "ground_truth_hallucination", "ground_truth_risk_direction", "ground_truth_risk_impact").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def verdicts(s, d):
    return spark_rows(s, d, VERDICT)


def scored_rows(s, d):
    m = V.meta_evaluate(judged_costs(s, d), with_costs=True)
    names = ("correctness", "hallucination", "risk_direction", "risk_impact")
    return m.select(*names, *(F.col(f"meta_eval_output.ground_truth_{n}").alias(f"gt_{n}") for n in names))


RATES = ("precision", "recall", "f1")
QUERIES = {
    "render_prompts": render_prompts,
    "rag_prompt": rag_prompt,
    "chat_prompt": chat_prompt,
    "generation_stats": lambda s, d: _round(J.generation_stats(qa(s, d), "answer"), "avg_length"),
    "parse_response": parse_response,
    "validate_verdict": validate_verdict,
    "cost_result": lambda s, d: cost_rows(s, d).select("doc_id", "cost.*", "cost_error"),
    "cost_gate": cost_gate,
    "cost_json": lambda s, d: cost_rows(s, d).filter("cost is not null").select("doc_id", J.cost_json(F.col("cost")).alias("json")),
    "reasoning_trace": reasoning_trace,
    "short_reasoning": short_reasoning,
    "failure_mode": failure_mode,
    "keyword_verdict": keyword_verdict,
    "judge_stages": judged,
    "judge_stages_hallucination": lambda s, d: judged(s, d, "hallucination"),
    "gt_correctness": gt_correctness,
    "gt_hallucination": gt_hallucination,
    "gt_risk_direction": gt_risk(V.gt_risk_direction, "direction"),
    "gt_risk_impact": gt_risk(V.gt_risk_impact, "impact"),
    "meta_eval": meta_eval,
    "confusion_binary": lambda s, d: _round(V.binary_metrics(verdicts(s, d), "verdict", "truth", ["lang"]), *RATES),
    "confusion_macro": lambda s, d: _round(V.macro_metrics(scored_rows(s, d), "risk_direction", "gt_risk_direction", V.DIRECTIONS), *RATES),
    "judge_scorecard": lambda s, d: _round(V.judge_scorecard(scored_rows(s, d)), *RATES),
    "calibration": lambda s, d: _round(V.calibration(verdicts(s, d), "verdict", "truth"), "raw", "q0", "q1"),
    "rogan_gladen": lambda s, d: V.calibration(verdicts(s, d), "verdict", "truth", ["lang"]).select("lang", F.round(V.rogan_gladen(F.col("raw"), F.col("q0"), F.col("q1")), 6).alias("corrected")),
    "bias_corrected_ci": lambda s, d: _round(V.bias_corrected(verdicts(s, d), 0.05, "verdict", "truth", ["lang"]), "raw", "corrected", "ci_lo", "ci_hi", "level", "q0", "q1"),
}

# SQL
_QA, _COST, _RESP, _VERD = (duck_rows(x) for x in (QA, COST, RESPONSE, VERDICT))


def _case(pairs, end="END"):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " " + end


def _body(c):
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^```(json)?', ''), '```$', ''), '^\s+|\s+$', '', 'g')"


def _object(c):
    return f"(json_valid({_body(c)}) AND coalesce(json_type(TRY_CAST({_body(c)} AS JSON)), '') = 'OBJECT')"


def _field(c, name, *types):
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"CASE WHEN {_object(c)} AND json_type(TRY_CAST({_body(c)} AS JSON), '$.{name}') IN ({kinds}) THEN json_extract_string(TRY_CAST({_body(c)} AS JSON), '$.{name}') END"


def _error(c):
    return f"CASE WHEN {_body(c)} = '' THEN 'empty response' WHEN NOT {_object(c)} THEN 'not a JSON object' END"


def _validated(stage, c, field, value):
    return f"SELECT doc_id, '{stage}' AS stage, CAST(v AS INT) AS value, CASE WHEN coalesce(e, CASE WHEN v IS NULL THEN '' END) IS NULL THEN coalesce(r, 'No reasoning provided') END AS reasoning, coalesce(e, CASE WHEN v IS NULL THEN 'missing or invalid {field}' END) AS verdict_error FROM (SELECT doc_id, {value} AS v, {_field(c, 'reasoning', 'VARCHAR')} AS r, {_error(c)} AS e FROM {_RESP})"


_INTS = ("BIGINT", "UBIGINT", "INTEGER")
_DIR = f"TRY_CAST({_field('direction_response', 'risk_direction', *_INTS)} AS INT)"
_IMP = f"CAST(trunc(TRY_CAST({_field('impact_response', 'risk_impact', 'DOUBLE', *_INTS)} AS DOUBLE)) AS INT)"
_COSTS = f"(SELECT doc_id, {', '.join(_field('cost_response', f, 'VARCHAR') + ' AS ' + f for f in ('money', 'time', 'steps', 'reasoning'))} FROM {_RESP})"


def _pick(texts):
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"(SELECT doc_id, lower([{listed}][doc_id % {len(texts)} + 1]) AS t FROM labels)"


def _gt_correct(a, b):
    ka, kb = f"list_distinct({keywords_sql(normalize_sql(a))})", f"list_distinct({keywords_sql(normalize_sql(b))})"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {normalize_sql(a)} = {normalize_sql(b)} OR coalesce(len({ka}) > 0 AND len({kb}) > 0 AND len(list_intersect({ka}, {kb})) / nullif(len(list_distinct(list_concat({ka}, {kb}))), 0)::DOUBLE >= 0.7, false) END)"


_OWN = f"list_distinct({keywords_sql(normalize_sql('c'))})"
_HALL = f"""CASE WHEN regexp_replace(coalesce(context, ''), '^\\s+|\\s+$', '', 'g') = '' THEN true WHEN len({claims_sql('answer')}) = 0 THEN NOT (length(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) < 50 OR {generic_sql('answer')})
  ELSE len(list_filter({claims_sql('answer')}, lambda c: NOT contains({normalize_sql('context')}, {normalize_sql('c')}) AND coalesce(len(list_intersect({_OWN}, {keywords_sql(normalize_sql('context'))})) / nullif(len({_OWN}), 0)::DOUBLE, 0) < 0.5)) > 0 END"""


def _n(p, f):
    return numeric_sql(f"{p}_{f}")


def _dir_case(f, up, down):
    e, a = _n("extracted", f), _n("actual", f)
    return f"{e} IS NOT NULL AND {a} IS NOT NULL", f"CASE WHEN {e} > {a} * {up}::DOUBLE THEN -1 WHEN {e} < {a} * {down}::DOUBLE THEN 1 ELSE 0 END"


_DIRECTION = "CAST(" + _case([_dir_case("money", 1.1, 0.9), _dir_case("time", 1.1, 0.9), _dir_case("steps", 1, 1)]) + " AS INT)"
_MOST = "greatest(" + ", ".join(f"coalesce(CASE WHEN {_n('actual', f)} > 0 THEN abs({_n('extracted', f)} - {_n('actual', f)}) / {_n('actual', f)} END, 0)" for f in ("money", "time")) + ")"
_IMPACT = "CAST(" + _case([(f"{_MOST} < 0.05", 0), (f"{_MOST} < 0.2", 1), (f"{_MOST} < 0.5", 2)], "ELSE 3 END") + " AS INT)"
_META = f"""(SELECT *, oc AND oh AND od AND oi AS judge_correct,
  CASE WHEN oc AND oh AND od AND oi THEN 'All validations passed' ELSE 'Some validations failed' END || '. Correctness verdict ' || CASE WHEN oc THEN 'validated' ELSE 'mismatch' END || '; Hallucination verdict ' || CASE WHEN oh THEN 'validated' ELSE 'mismatch' END
  || '; Risk direction ' || CASE WHEN od THEN 'validated' ELSE 'mismatch' END || '; Risk impact ' || CASE WHEN oi THEN 'validated' ELSE 'mismatch' END || '.' AS explanation
FROM (SELECT *, correctness = gt_correctness AS oc, hallucination = gt_hallucination AS oh, NOT correctness OR risk_direction = coalesce(gt_risk_direction, 0) AS od, NOT correctness OR abs(risk_impact - gt_risk_impact) <= 1 AS oi
FROM (SELECT l_orderkey, judged_correct AS correctness, l_orderkey % 2 = 0 AS hallucination, judged_direction AS risk_direction, judged_impact AS risk_impact,
  {_gt_correct('answer', 'context')} AS gt_correctness, {_HALL} AS gt_hallucination, CASE WHEN judged_correct THEN {_DIRECTION} END AS gt_risk_direction, CASE WHEN judged_correct THEN {_IMPACT} END AS gt_risk_impact FROM {_COST})))"""


def _div(a, b):
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def _binary(pred, actual, source, group=""):
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return f"""SELECT {g}tp, tn, fp, fn, total, p AS precision, r AS recall, {_div('2 * p * r', 'p + r')} AS f1 FROM (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM (
  SELECT {g}count(*) FILTER ({pred} AND {actual}) AS tp, count(*) FILTER (NOT {pred} AND NOT {actual}) AS tn, count(*) FILTER ({pred} AND NOT {actual}) AS fp, count(*) FILTER (NOT {pred} AND {actual}) AS fn, count(*) FILTER ({pred} IS NOT NULL AND {actual} IS NOT NULL) AS total FROM {source} {by}))"""


def _rounded(sql, lead=""):
    return f"SELECT {lead}round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(total AS BIGINT) AS total FROM ({sql})"


def _macro(pred, actual, classes):
    each = " UNION ALL ".join(_binary(f"({pred} = {c})", f"({actual} = {c})", _META) for c in classes)
    return f"SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, max(total) AS total FROM ({each})"


def _cal(group=""):
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return f"""(SELECT {g}raw, CASE WHEN m0 > 0 THEN (tn + 1) / (m0 + 2)::DOUBLE ELSE 0.5 END AS q0, CASE WHEN m1 > 0 THEN (tp + 1) / (m1 + 2)::DOUBLE ELSE 0.5 END AS q1, n, m0, m1 FROM (
  SELECT {g}count(*) FILTER (NOT truth) AS m0, count(*) FILTER (truth) AS m1, count(*) FILTER (NOT truth AND NOT verdict) AS tn, count(*) FILTER (truth AND verdict) AS tp, count(*) AS n, avg(coalesce(verdict, false)::INT) AS raw FROM {_VERD} {by}))"""


def _prompt_size(stage, *columns):
    """The length of a stage's prompt with these values in place of its placeholders."""
    fixed = len(J.TEMPLATES[stage]) - sum(len(p) + 2 for p in J.REQUIRED[stage])
    return f"({fixed} + " + " + ".join(f"coalesce(length({c}), 0)" for c in columns) + ")"


def _judged_sql(gate):
    """What the stand-in model says follows from the lengths of its prompts; both costs are $5."""
    impact = len(J.TEMPLATES["risk_impact"]) - sum(len(p) + 2 for p in J.REQUIRED["risk_impact"]) + 2 * len('{"money":"$5"}')
    return f"""SELECT example_id, correctness, hallucination, CAST(CASE WHEN {gate} THEN d END AS INT) AS risk_direction, CAST(CASE WHEN {gate} THEN {impact % 4} END AS INT) AS risk_impact, CAST(NULL AS VARCHAR) AS failure_mode, CAST(NULL AS VARCHAR) AS judge_error
FROM (SELECT doc_id AS example_id, {_prompt_size('correctness', "'what?'", 'answer', 'reference')} % 3 <> 0 AS correctness, {_prompt_size('hallucination', 'context', 'answer')} % 5 = 0 AS hallucination, {_prompt_size('risk_direction', 'answer', 'context')} % 3 - 1 AS d FROM {_QA} WHERE context IS NOT NULL)"""


_RG = "greatest(0, least(1, CASE WHEN abs(q0 + q1 - 1) < 1e-12 THEN raw ELSE (raw + q0 - 1) / (q0 + q1 - 1) END))"
_Z = f"{V.NormalDist().inv_cdf(0.975)!r}"
_TURNS = "string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)"
SQL = {
    "render_prompts": f"""SELECT doc_id, 'Question: ' || doc_id || chr(10) || 'Answer: ' || answer || chr(10) || 'Reference: ' || coalesce(reference, '') || chr(10) || 'Say {{"correctness_binary": true}} or false.' AS prompt FROM {_QA}""",
    "rag_prompt": f"""SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND (context IS NOT NULL OR reference IS NOT NULL) THEN 'Context information:' || chr(10) || concat_ws(chr(10) || chr(10), context, reference) || chr(10) || chr(10) || 'Question: ' || answer || chr(10) || chr(10)
  || 'Answer the question based on the context provided above. If the answer cannot be found in the context, say "I cannot answer this question based on the provided context."' || chr(10) || chr(10) || 'Answer:' ELSE 'Question: ' || answer || chr(10) || chr(10) || 'Answer:' END AS prompt FROM {_QA}""",
    "chat_prompt": f"""SELECT conv_id, {_TURNS} || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'system: Use the following context to answer the user''s question:' || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || 'second' ELSE '' END || chr(10) || chr(10) || 'user: what next?' AS prompt FROM conversations GROUP BY conv_id""",
    "generation_stats": f"SELECT count(answer) AS n, round(avg(length(answer)), 6) AS avg_length, min(length(answer)) AS min_length, max(length(answer)) AS max_length FROM {_QA}",
    "parse_response": f"SELECT doc_id, CAST({_field('response', 'correctness_binary', 'BOOLEAN')} AS BOOLEAN) AS verdict, {_field('response', 'reasoning', 'VARCHAR')} AS reasoning, {_error('response')} AS parse_error FROM {_RESP}",
    "validate_verdict": " UNION ALL ".join((_validated("correctness", "response", "correctness_binary", f"CAST({_field('response', 'correctness_binary', 'BOOLEAN')} AS BOOLEAN)"), _validated("risk_direction", "direction_response", "risk_direction", f"CASE WHEN {_DIR} BETWEEN -1 AND 1 THEN {_DIR} END"), _validated("risk_impact", "impact_response", "risk_impact", f"CASE WHEN {_IMP} BETWEEN 0 AND 3 THEN {_IMP} END"))),
    "cost_result": f"SELECT doc_id, CASE WHEN reasoning IS NOT NULL THEN money END AS money, CASE WHEN reasoning IS NOT NULL THEN time END AS time, CASE WHEN reasoning IS NOT NULL THEN steps END AS steps, reasoning, CASE WHEN reasoning IS NULL THEN 'missing reasoning' END AS cost_error FROM {_COSTS}",
    "cost_gate": f"""SELECT CASE WHEN l_orderkey % 60 = 0 OR (extracted_money IS NULL AND extracted_time IS NULL AND extracted_steps IS NULL) THEN 'No costs found in model answer' WHEN l_orderkey % 7 = 0 THEN 'No costs found in retrieved context' END AS reason, count(*) AS n FROM {_COST} GROUP BY 1""",
    "cost_json": f"""SELECT doc_id, '{{' || concat_ws(',', '"money":"' || money || '"', '"time":"' || time || '"', '"steps":"' || steps || '"') || '}}' AS json FROM {_COSTS} WHERE reasoning IS NOT NULL""",
    "reasoning_trace": f"""SELECT concat_ws(chr(10) || chr(10), 'Correctness Analysis: same', 'Correctness Result: ' || CASE WHEN judged_correct THEN 'True' ELSE 'False' END, 'Hallucination Analysis: grounded', 'Hallucination Result: ' || CASE WHEN l_orderkey % 2 = 0 THEN 'True' ELSE 'False' END,
  CASE WHEN judged_correct THEN 'Risk Direction Analysis: cheaper' END, CASE WHEN judged_correct THEN 'Risk Direction Result: ' || CASE judged_direction WHEN -1 THEN 'care avoidance risk (-1)' WHEN 0 THEN 'no clear direction (0)' ELSE 'unexpected cost risk (+1)' END END,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Risk Impact Analysis: small' END, CASE WHEN l_orderkey % 3 = 0 THEN 'Risk Impact Result: ' || judged_impact END) AS trace, count(*) AS n FROM {_COST} GROUP BY 1""",
    "short_reasoning": f"""SELECT concat_ws('; ', CASE WHEN judged_correct THEN 'Answer is correct' ELSE 'Answer is incorrect' END, CASE WHEN l_orderkey % 2 = 0 THEN 'hallucination detected' ELSE 'no hallucination detected' END,
  CASE WHEN judged_correct THEN 'risk direction: ' || CASE judged_direction WHEN -1 THEN 'care avoidance risk' WHEN 0 THEN 'no clear risk direction' ELSE 'unexpected cost risk' END END, CASE WHEN l_orderkey % 3 = 0 THEN 'risk impact: ' || judged_impact END) || '.' AS reasoning, count(*) AS n FROM {_COST} GROUP BY 1""",
    "failure_mode": "SELECT doc_id, " + _case([(f"contains(t, '{p}')", f"'{n}'") for p, n in J.FAILURE_MODES]) + f" AS mode FROM {_pick(PHRASES)}",
    "keyword_verdict": f"""SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^a-z])(no|not|false|incorrect|inaccurate)([^a-z]|$)') THEN false ELSE regexp_matches(t, '(^|[^a-z])(yes|true|correct|accurate)([^a-z]|$)') END AS verdict, regexp_matches(t, 'yes|true|correct|accurate') AS verdict_compat,
  CASE WHEN regexp_matches(t, 'care avoidance|overestimate|-1') THEN -1 WHEN regexp_matches(t, 'unexpected cost|underestimate|1') THEN 1 WHEN regexp_matches(t, 'no clear|neutral|0') THEN 0 END AS direction,
  CASE WHEN regexp_matches(t, '3|severe|high') THEN 3 WHEN regexp_matches(t, '2|moderate|medium') THEN 2 WHEN regexp_matches(t, '1|mild|low') THEN 1 WHEN regexp_matches(t, '0|none|minimal') THEN 0 END AS impact FROM {_pick(FREE)}""",
    "judge_stages": _judged_sql("correctness"),
    "judge_stages_hallucination": _judged_sql("hallucination"),
    "gt_correctness": f"SELECT doc_id, {_gt_correct('answer', 'reference')} AS gt FROM {_QA}",
    "gt_hallucination": f"SELECT l_orderkey, count(*) FILTER ({_HALL}) AS unsupported, count(*) AS n FROM {_COST} GROUP BY 1",
    "gt_risk_direction": f"SELECT l_orderkey, {_DIRECTION} AS direction, count(*) AS n FROM {_COST} GROUP BY 1, 2",
    "gt_risk_impact": f"SELECT l_orderkey, {_IMPACT} AS impact, count(*) AS n FROM {_COST} GROUP BY 1, 2",
    "meta_eval": f"SELECT explanation, judge_correct, gt_correctness AS ground_truth_correctness, gt_hallucination AS ground_truth_hallucination, gt_risk_direction AS ground_truth_risk_direction, gt_risk_impact AS ground_truth_risk_impact, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM {_META} GROUP BY ALL",
    "confusion_binary": _rounded(_binary("verdict", "truth", _VERD, "lang"), "lang, "),
    "confusion_macro": _rounded(_macro("risk_direction", "gt_risk_direction", V.DIRECTIONS)),
    "judge_scorecard": " UNION ALL ".join([_rounded(_binary(m, f"gt_{m}", _META), f"'{m}' AS metric, ") for m in ("correctness", "hallucination")] + [_rounded(_macro(m, f"gt_{m}", c), f"'{m}' AS metric, ") + " WHERE total > 0" for m, c in (("risk_direction", V.DIRECTIONS), ("risk_impact", V.IMPACTS))]),
    "calibration": f"SELECT round(raw, 6) AS raw, round(q0, 6) AS q0, round(q1, 6) AS q1, n, m0, m1 FROM {_cal()}",
    "rogan_gladen": f"SELECT lang, round({_RG}, 6) AS corrected FROM {_cal('lang')}",
    "bias_corrected_ci": f"SELECT lang, round(raw, 6) AS raw, round(c, 6) AS corrected, round(greatest(0, c - w), 6) AS ci_lo, round(least(1, c + w), 6) AS ci_hi, 0.95::DOUBLE AS level, round(q0, 6) AS q0, round(q1, 6) AS q1, n, m0, m1 FROM (SELECT *, {_RG} AS c, {_Z} * sqrt(raw * (1 - raw) / n) AS w FROM {_cal('lang')})",
}
