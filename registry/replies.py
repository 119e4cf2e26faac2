"""Generation, reply parsing and streamed replies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import MESSY_CUSTOMERS, WS, messy_customers, sql_json, table
from registry.rows import CELLS, DEFINITIONS, FILLED, SQL_PAYLOAD, sql_prompt
from rowloom.functions.text import json_quote
from rowloom.operators.payload import END_MARKER
from rowloom.operators.replies import json_value, key_line_value, new_value, strip_markers, unquote
from rowloom.plans.enrich import add_column, generate_columns
from rowloom.streaming.frames import assemble_replies

#: Forms a reply may take; ``{j}`` is the text as JSON, ``{t}`` the text itself.
FORMS = [
    '{{"new_value": {j}}}',
    "```json\n{{\"new_value\": {j}}}\n```\n" + END_MARKER,
    "Sure, here it is: {{\"new_value\": {j}}} " + END_MARKER,
    '{{"new_value": null}}',
    '{{"none": 1}} {{"note": {j}, "new_value": [1, {j}, {{"a": null}}]}}',
    "- new_value: {j}\n  other: x\n NEW_VALUE : 'it''s \"so\"'",
    "  {t}<end_of_turn>",
    "```YAML\nnew_value: first\\nsecond\n```",
    '{{"new_value": {j}, "new_value": "last"}}',
    "new_value: \"a\" and \"b\"\nnew_value: \"\\u00e9\\\"\"",
]


def _key() -> Column:
    return F.col("conv_id") + F.col("turn")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per turn, in all forms."""
    quoted = json_quote(F.col("text"))
    out = None
    for number, form in enumerate(FORMS):
        value = _fill(form, quoted, F.col("text"))
        matches = _key() % len(FORMS) == number
        out = F.when(matches, value) if out is None else out.when(matches, value)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("reply"))


def _fill(form: str, quoted: Column, text: Column) -> Column:
    pieces = form.replace("{j}", "\0j\0").replace("{t}", "\0t\0").replace("{{", "{").replace("}}", "}").split("\0")
    return F.concat(*[quoted if p == "j" else text if p == "t" else F.lit(p) for p in pieces])


def _sql_form(form: str) -> str:
    pieces = form.replace("{j}", "\0j\0").replace("{t}", "\0t\0").replace("{{", "{").replace("}}", "}").split("\0")
    parts = [sql_json("text") if p == "j" else "text" if p == "t" else "'" + p.replace("'", "''") + "'" for p in pieces]
    return "(" + " || ".join(parts) + ")"


_cases = " ".join(f"WHEN {i} THEN {_sql_form(f)}" for i, f in enumerate(FORMS))
REPLIES = f"SELECT *, CASE (conv_id + turn) % {len(FORMS)} {_cases} END AS reply FROM conversations"


def _parsed(column):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return replies(spark, sf_dir).select("conv_id", "turn", column(F.col("reply")).alias("value"))

    return query


def unquoted_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars in double, single and no quotes, some of them not valid JSON."""
    text, key = F.col("text"), _key()
    scalar = (
        F.when(key % 5 == 0, json_quote(text))
        .when(key % 5 == 1, F.concat(F.lit("'"), F.regexp_replace(text, "[\"\\\\\n]", " "), F.lit("'")))
        .when(key % 5 == 2, F.concat(F.lit('"'), F.regexp_replace(text, '["\\\\]', " "), F.lit('\\x" ')))
        .when(key % 5 == 3, F.concat(F.lit('"'), F.col("role"), F.lit('" or "'), F.col("role"), F.lit('"')))
        .otherwise(F.concat(F.lit(" \t"), F.col("role"), F.lit('"\n')))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", unquote(scalar).alias("value"))


def _echo():
    """A stand-in for a model: answers with the length of the prompt; some requests fail."""

    def generate(requests):
        out = []
        for request in requests:
            length = len(request["prompt"])
            if length % 10 == 3:
                raise RuntimeError(f"no answer to {length} characters")
            value = json.dumps({"new_value": f"{length} of {request['max_tokens']}"})
            out.append(value + "\n" + request["stop"][0])
        return out

    return generate


def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = messy_customers(spark, sf_dir)
    return generate_columns(customers, CELLS, DEFINITIONS, _echo)


def enriched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column in one pass: the first 1,000 rows that hold something get a value."""

    def reply(prompt: Column) -> Column:
        return F.concat(F.lit('{"new_value": "'), F.length(prompt).cast("string"), F.lit(f'"}} {END_MARKER}'))

    customers = messy_customers(spark, sf_dir)
    return add_column(customers, CELLS, "Say something.", reply, column=["Note"], max_rows=1000)


def assembled_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frames of a conversation's reply: usage reports, end marks and junk in between."""
    piece = F.concat(F.lit('data: {"choices": [{"delta": {"content": '), json_quote(F.col("text")), F.lit("}}]}"))
    usage = F.concat(
        F.lit('\ndata: {"choices": [], "usage": {"prompt_tokens": '), F.length("text").cast("string"),
        F.lit(', "completion_tokens": '), (F.col("turn") * 10 + 1).cast("string"), F.lit("}}"),
    )
    frame = (
        F.when(_key() % 5 == 0, F.concat(F.lit(": ping\n"), piece, usage))
        .when(_key() % 5 == 1, F.concat(piece, F.lit("\ndata: [DONE]\n"), piece))
        .when(_key() % 5 == 2, F.concat(F.lit("data: {broken\n"), piece))
        .otherwise(piece)
    )
    frames = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("frame_no"), frame.alias("frame")
    )
    return assemble_replies(frames, prompt_tokens=F.lit(7))


QUERIES = {
    "stripped_replies": _parsed(strip_markers),
    "json_values": _parsed(json_value),
    "key_line_values": _parsed(key_line_value),
    "unquoted_scalars": unquoted_scalars,
    "new_values": _parsed(new_value),
    "generated_columns": generated_columns,
    "enriched_customers": enriched_customers,
    "assembled_replies": assembled_replies,
}

_STRIPPED = f"""
    SELECT *, trim(regexp_replace(replace(replace(reply, '{END_MARKER}', ''), '<end_of_turn>', ''),
                   '(?i)```(?:json|yaml|yml|text)?\\s*([\\s\\S]*?)```', '\\1', 'g'), {WS}) AS body
    FROM ({REPLIES})"""

_JSON_VALUE = f"""CASE (conv_id + turn) % {len(FORMS)}
    WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text WHEN 3 THEN ''
    WHEN 4 THEN '[1, ' || {sql_json('text')} || ', {{"a": null}}]' WHEN 8 THEN 'last' END"""

#: Quotes of one scalar ``v`` taken away.
_UNQUOTE = """CASE
    WHEN v LIKE '"%"' AND json_valid(v) THEN json_extract_string(v, '$')
    WHEN v LIKE '"%"' THEN substr(v, 2, len(v) - 2)
    WHEN v LIKE '''%''' THEN coalesce(
        CASE WHEN json_valid('"' || replace(substr(v, 2, len(v) - 2), '"', '\\"') || '"')
             THEN json_extract_string('"' || replace(substr(v, 2, len(v) - 2), '"', '\\"') || '"', '$') END,
        substr(v, 2, len(v) - 2))
    ELSE v END"""

_KEY_LINES = f"""
    SELECT conv_id, turn, string_agg(replace(w, '\\n', chr(10)), chr(10) ORDER BY line_ord) AS value
    FROM (SELECT *, {_UNQUOTE} AS w
          FROM (SELECT conv_id, turn, line_ord,
                       trim(regexp_extract(line, '(?i)^\\s*(?:-\\s*)?new_value\\s*:\\s*(.*)$', 1), {WS}) AS v
                FROM (SELECT conv_id, turn, generate_subscripts(string_split(body, chr(10)), 1) AS line_ord,
                             unnest(string_split(body, chr(10))) AS line
                      FROM ({_STRIPPED}))
                WHERE regexp_matches(line, '(?i)^\\s*(?:-\\s*)?new_value\\s*:')))
    GROUP BY conv_id, turn"""

_PLAIN_KEY_LINES = _KEY_LINES.replace(_STRIPPED, f"SELECT *, reply AS body FROM ({REPLIES})")

_PROMPTS = {
    d["headers"][0]: sql_prompt(SQL_PAYLOAD, f"'{d['instructions']}'", "''", f"'{d.get('example', '')}'")
    for d in DEFINITIONS
}
_COMPACT = f"""len('{{"name": ' || {sql_json("coalesce(name, 'null')")} || ', "segment": '
               || {sql_json("coalesce(segment, 'null')")} || '}}')"""


def _echoed(length: str) -> str:
    return f"""CASE WHEN NOT {FILLED} THEN ''
        WHEN {length} % 10 = 3 THEN 'Error: no answer to ' || {length} || ' characters'
        ELSE {length} || ' of ' || budget END"""


SQL = {
    "stripped_replies": f"SELECT conv_id, turn, body AS value FROM ({_STRIPPED})",
    "json_values": f"SELECT conv_id, turn, {_JSON_VALUE} AS value FROM conversations",
    "key_line_values": f"""
        SELECT c.conv_id, c.turn, k.value FROM conversations c LEFT JOIN ({_PLAIN_KEY_LINES}) k USING (conv_id, turn)""",
    "new_values": f"""
        SELECT conv_id, turn, trim(coalesce(from_json, k.value, body), {WS}) AS value
        FROM (SELECT conv_id, turn, body, {_JSON_VALUE} AS from_json FROM ({_STRIPPED}))
        LEFT JOIN ({_KEY_LINES}) k USING (conv_id, turn)""",
    "unquoted_scalars": f"""
        SELECT conv_id, turn, {_UNQUOTE} AS value
        FROM (SELECT conv_id, turn, trim(CASE (conv_id + turn) % 5
                  WHEN 0 THEN {sql_json('text')}
                  WHEN 1 THEN '''' || regexp_replace(text, '["\\\\\\n]', ' ', 'g') || ''''
                  WHEN 2 THEN '"' || regexp_replace(text, '["\\\\]', ' ', 'g') || '\\x" '
                  WHEN 3 THEN '"' || role || '" or "' || role || '"'
                  ELSE ' ' || chr(9) || role || '"' || chr(10) END, {WS}) AS v
              FROM conversations)""",
    "generated_columns": f"""
        SELECT row_id, name, segment, balance, {_echoed('a')} AS "Segment - short", {_echoed('b')} AS "Rating"
        FROM (SELECT *, len({_PROMPTS['Segment']}) AS a, len({_PROMPTS['Rating']}) AS b,
                     200 + greatest(50, least(500, {_COMPACT} // 4 * 2)) AS budget
              FROM ({MESSY_CUSTOMERS}))""",
    "enriched_customers": f"""
        SELECT row_id, name, segment, balance,
               CASE WHEN filled AND place <= 1000
                    THEN CAST(len({sql_prompt(SQL_PAYLOAD, "'Say something.'", "''", "''")}) AS VARCHAR) ELSE '' END AS "Note"
        FROM (SELECT *, sum(CASE WHEN filled THEN 1 ELSE 0 END) OVER (ORDER BY row_id) AS place
              FROM (SELECT *, {FILLED} AS filled FROM ({MESSY_CUSTOMERS})))""",
    "assembled_replies": """
        WITH last AS (
            SELECT conv_id, max(turn) AS turn, arg_max(len(text), turn) AS prompt, max(turn) * 10 + 1 AS completion
            FROM conversations WHERE (conv_id + turn) % 5 = 0 GROUP BY conv_id)
        SELECT c.conv_id AS request_id, string_agg(c.text, '' ORDER BY c.turn) AS reply,
               CAST(coalesce(any_value(l.prompt), 7) AS BIGINT) AS prompt_tokens,
               CAST(coalesce(any_value(l.completion), 0)
                    + coalesce(sum(CASE WHEN c.text <> '' AND c.turn > coalesce(l.turn, -1)
                                        THEN greatest(1, len(c.text) // 4) END), 0) AS BIGINT) AS completion_tokens
        FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id
        GROUP BY c.conv_id""",
}
