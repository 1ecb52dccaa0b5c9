"""Queries of model messages, replies and tool calls, over conversations and bodies written from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import messages as M
from corpusmill.plans.catalog import STATUS, _status, query
from corpusmill.sources.tables import table

N = "(event_id % 100)"


def _chat(spark, d):
    """conversations as messages: every third turn that is no system turn is a tool's result."""
    tool = (F.col("turn") % 3 == 2) & (F.col("role") != "system")
    return table(spark, d, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("turn"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.lit("").alias("tool_call_id"), F.when(tool, "find").alias("name"), F.lit(None).cast(M.CALLS).alias("tool_calls"),
    )


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system' AND text <> ''), '') AS system FROM conversations GROUP BY conv_id")
def system_prompts(spark, d):
    return M.system_of(_chat(spark, d))


@query("""SELECT conv_id, min(turn)::INT AS turn, any_value(CASE WHEN kind = 'text' AND role = 'assistant' THEN 'assistant' ELSE 'user' END) AS role, count(*)::INT AS n_blocks, string_agg(kind || ':' || coalesce(text, ''), '|' ORDER BY turn) AS said
FROM (SELECT *, sum(CASE WHEN kind = 'tool_result' AND before = 'tool_result' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS before
FROM (SELECT conv_id, turn, text, role, CASE WHEN turn % 3 = 2 THEN 'tool_result' ELSE 'text' END AS kind FROM conversations WHERE role <> 'system') WHERE kind = 'tool_result' OR role <> 'assistant' OR text <> '')) GROUP BY conv_id, run""")
def to_turns(spark, d):
    said = F.array_join(F.transform("blocks", lambda b: F.concat(b["type"], F.lit(":"), F.coalesce(b["text"], F.lit("")))), "|")
    return M.to_blocks(_chat(spark, d)).select("conv_id", "turn", "role", F.size("blocks").alias("n_blocks"), said.alias("said"))


@query(f"SELECT event_id, {N}::BIGINT AS prompt_tokens, CASE WHEN {N} = 0 THEN 3 ELSE 7 END::BIGINT AS completion_tokens, CASE WHEN {N} = 0 THEN 0 ELSE 3 END::BIGINT AS cached_tokens, {N} = 0 AS estimated FROM events")
def usage_openai(spark, d):
    body = F.expr("""if(event_id % 100 = 0, '{"choices":"abcdefgh"}', concat('{"choices":[],"usage":{"prompt_tokens":', event_id % 100, ',"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":3}}}'))""")
    return table(spark, d, "events").select("event_id", M.usage_of_choices(body).alias("u")).select("event_id", "u.*")


@query(f"SELECT event_id, ({N} + 4 + 5)::BIGINT AS prompt_tokens, 6::BIGINT AS completion_tokens, 4::BIGINT AS cached_tokens FROM events")
def usage_anthropic(spark, d):
    body = F.expr("""concat('{"usage":{"input_tokens":', event_id % 100, ',"cache_read_input_tokens":4,"cache_creation_input_tokens":5,"output_tokens":6}}')""")
    return table(spark, d, "events").select("event_id", M.usage_of_blocks(body).alias("u")).select("event_id", "u.prompt_tokens", "u.completion_tokens", "u.cached_tokens")


@query(f"SELECT event_id, 'a' || {N} || 'b' AS content, 1 AS n_calls, '{{\"q\":' || {N} || '}}' AS arguments, 'tool_use' AS finish_reason FROM events")
def from_blocks(spark, d):
    body = F.expr("""concat('{"content":[{"type":"text","text":"a', event_id % 100, '"},{"type":"tool_use","id":"i","name":"n","input":{"q":', event_id % 100, '}},{"type":"text","text":"b"}],"stop_reason":"tool_use"}')""")
    return table(spark, d, "events").select("event_id", M.from_body(body).alias("m")).select("event_id", "m.content", F.size("m.tool_calls").alias("n_calls"), F.get("m.tool_calls", F.lit(0))["arguments"].alias("arguments"), "m.finish_reason")


@query(f"SELECT event_id, 'HTTP ' || {STATUS} || ': ' || CASE event_id % 4 WHEN 0 THEN 'slow down' WHEN 1 THEN 'plain' WHEN 2 THEN '<html>' ELSE 'Teapot' END AS message FROM events")
def error_message(spark, d):
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"error":{"message":"slow down"}}').when(k == 1, '{"error":"plain"}').when(k == 2, "<html>").otherwise("{}")
    return table(spark, d, "events").select("event_id", M.error_message(_status(), body, F.lit("Teapot")).alias("message"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown tool: fly' ELSE 'missing or invalid required argument ''query''' END AS error, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 5 END AS n FROM events")
def tool_arguments(spark, d):
    k = F.col("event_id") % 4
    args = F.when(k == 0, '{"query":"a b","max_results":3}').when(k == 1, "{}").when(k == 2, '{"query":" ","max_results":"x"}').otherwise('{"query":7}')
    name = F.when(k == 1, "fly").otherwise("web_search")
    required = {"web_search": ["query"], "site_search": ["site", "query"], "open_url": ["url"]}
    return table(spark, d, "events").select("event_id", M.call_error(name, args, required).alias("error"), M.optional_int(args, "max_results", 5).alias("n"))


@query(f"SELECT event_id, '{{\"n\":' || {N} || '}}' AS reply FROM events")
def reply_json(spark, d):
    fenced = F.expr("""concat(if(event_id % 2 = 0, '```json\n', 'Here: '), '{"n":', event_id % 100, '}', if(event_id % 2 = 0, '\n```', ' and {more}'))""")
    return table(spark, d, "events").select("event_id", M.reply_json(fenced).alias("reply"))


@query("SELECT event_id, event_id % 2 = 0 AS sampling FROM events")
def accepts_sampling(spark, d):
    return table(spark, d, "events").select("event_id", M.accepts_sampling(F.when(F.col("event_id") % 2 == 0, "gpt-4o").otherwise(M.NO_SAMPLING[0] + "-x")).alias("sampling"))
