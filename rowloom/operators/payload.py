"""From a row to a prompt: cells as text, JSON payloads, budgets, prompt assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import named
from rowloom.functions.text import canonical_string, json_object

# Characters per token, and the pieces of the output-token budget.
CHARS_PER_TOKEN = 4
BUDGET_BASE = 200
BUDGET_PER_INPUT_TOKEN = 2
BUDGET_MIN, BUDGET_MAX = 50, 500

# The name a generated column gets when none is given.
DEFAULT_COLUMN = "generated_column"

# The wording of the prompt, the output contract and the end marker.
END_MARKER = "[[ ## completed ## ]]"
TASK = "Generate a new column value based on source data and instructions."
LABELS = {
    "source_data": "Source column data from the current row",
    "task_instructions": "Instructions for generating the new column",
    "context": "Additional context from RAG documents",
    "example": "Example showing input and expected output for reference",
    "new_value": "The generated value for the new column",
}
CLOSING = "Please generate the requested output based on the input data above."
CONTRACT = (
    "\nOutput format:\n"
    '- Return a single JSON object with exactly one key "new_value" whose value is the final answer string.\n'
    "- Do not include code fences; do not add extra keys; do not prefix with list markers.\n"
    "- End your reply with the exact marker [[ ## completed ## ]].\n"
)


@dataclass(frozen=True)
class PromptTemplate:
    """The wording around the inputs of a prompt."""

    task: str = TASK
    labels: Mapping[str, str] = field(default_factory=lambda: dict(LABELS))
    closing: str = CLOSING
    contract: str = CONTRACT


def cells_as_text(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column]]:
    return [(c, canonical_string(named(c), df.schema[c].dataType)) for c in columns]


def row_payload(df: DataFrame, columns: Sequence[str], indent: int | None = 2) -> Column:
    """The chosen cells of a row as JSON text: ``indent=2`` for prompts, None for length estimates."""
    return json_object(cells_as_text(df, columns), indent)


def approx_tokens(length: Column) -> Column:
    """About four characters per token, at least one token."""
    return F.greatest(F.lit(1), F.floor(length / CHARS_PER_TOKEN).cast("int"))


def token_budget(source_length: Column, context_length: Column | int = 0) -> Column:
    """Output tokens allowed for a request, from the lengths of its payload and context."""
    context = F.lit(context_length) if isinstance(context_length, int) else context_length
    tokens = F.floor((source_length + context) / CHARS_PER_TOKEN)
    extra = F.greatest(F.lit(BUDGET_MIN), F.least(F.lit(BUDGET_MAX), tokens * BUDGET_PER_INPUT_TOKEN))
    return (BUDGET_BASE + extra).cast("int")


def prompt(
    payload: Column,
    instructions: Column | str,
    context: Column | str = "",
    example: Column | str = "",
    template: PromptTemplate = PromptTemplate(),
) -> Column:
    """The full prompt: task line, labelled inputs, expected output, closing line, contract."""
    inputs = {
        "source_data": payload, "task_instructions": instructions, "context": context, "example": example,
    }
    pieces: list[Column] = [F.lit(f"Task: {template.task}\n\n")]
    for name, value in inputs.items():
        text = F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit(""))
        pieces += [F.lit(f"{template.labels[name]}:\n"), text, F.lit("\n\n")]
    outputs = [f"- {name}: {label}\n" for name, label in template.labels.items() if name not in inputs]
    pieces.append(F.lit("Expected Output:\n" + "".join(outputs) + f"\n{template.closing}\n{template.contract}"))
    return F.concat(*pieces)


def output_column_name(
    headers: Sequence[str] | str | None, existing: Sequence[str] = (), generated: Sequence[str] = ()
) -> str:
    """Header parts joined by `` - ``; a name the table has already becomes ``generated_<n>``.

    ``n`` counts the generated names (this one included) up to it in string order.
    """
    if not headers:
        return DEFAULT_COLUMN
    name = headers if isinstance(headers, str) else " - ".join(headers)
    if name not in existing:
        return name
    return f"generated_{sum(1 for other in set(generated) | {name} if other <= name)}"
