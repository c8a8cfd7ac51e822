"""Query texts, prompt metadata, prompts and messages as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import clean_value

# The instruction and the worked examples of the text generator.
SYSTEM_PROMPT = """You create concise factual clinical descriptions for terminology
mapping to SNOMED CT.

You receive:
- the source table name;
- the query column name;
- the query value;
- the selected context column names;
- the values found in those context columns.

Write one or two clear sentences describing the query value using only
the supplied information.

Do not infer missing facts.
Do not invent diagnoses.
Do not add information that was not provided.
Return only the description without preamble."""
EXAMPLES = (
    {
        "test_name": "URINE CULTURE",
        "spec_type_desc": "URINE",
        "org_name": "ESCHERICHIA COLI",
        "ab_name": "AMPICILLIN",
        "ideal_description": "A urine culture test that grew Escherichia coli, subsequently tested for susceptibility to ampicillin.",
    },
    {
        "test_name": "BLOOD CULTURE, ROUTINE",
        "spec_type_desc": "BLOOD CULTURE",
        "org_name": "STAPHYLOCOCCUS AUREUS",
        "ab_name": "VANCOMYCIN",
        "ideal_description": "A routine blood culture test that grew Staphylococcus aureus, subsequently tested for susceptibility to vancomycin.",
    },
)
MISSING = "missing"
# The columns that the pipeline adds.
TEXTS = ("algorithm_1_text", "algorithm_2_text", "algorithm_ai_text")
METADATA, ROW = "algorithm_ai_metadata", "row_id"
METHODS = ("algorithm_1", "algorithm_2", "algorithm_ai", "multi_match", "elastic_fuzzy", "jaccard")
#: A full-row prompt leaves them out.
DERIVED = frozenset((ROW, METADATA, *TEXTS, *(f"{m}_matches" for m in METHODS)))
Values = Callable[[str], Column]


def require(df: DataFrame, query_column: str, context_columns: Sequence[str] = ()) -> None:
    """Raises ValueError with the sorted names of columns that are not there."""
    if missing := sorted({query_column, *context_columns} - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")


def _cell(name: str) -> Column:
    return clean_value(F.col(f"`{name}`"))


def query_text(query_column: str) -> Column:
    return _cell(query_column)


def context_text(query_column: str, context_columns: Sequence[str], value: Values = _cell) -> Column:
    """``column: value`` lines, query first; empty values leave no line."""
    lines = [F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in (query_column, *context_columns)]
    return F.concat_ws("\n", *lines)


def metadata(table_name: str, query_column: str, context_columns: Sequence[str]) -> Column:
    """What a prompt is built from; context_values is null when there are no context columns."""
    pairs = [x for c in context_columns for x in (F.lit(c), _cell(c))]
    return F.struct(
        F.lit(table_name).alias("table_name"),
        F.lit(query_column).alias("query_column"),
        _cell(query_column).alias("query_value"),
        F.array(*map(F.lit, context_columns)).cast("array<string>").alias("context_columns"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("context_values"),
    )


def semantic_inputs(df: DataFrame, table_name: str, query_column: str, context_columns: Sequence[str] = ()) -> DataFrame:
    """Adds the three text representations of a record."""
    require(df, query_column, context_columns)
    return df.withColumns(
        {
            "algorithm_1_text": query_text(query_column),
            "algorithm_2_text": context_text(query_column, context_columns),
            "algorithm_ai_metadata": metadata(table_name, query_column, context_columns),
        }
    )


def metadata_key(table_name: str, query_column: str, context_columns: Sequence[str]) -> Column:
    """Identity of a prompt: table, query column, value, then column=value in the order of the names."""
    return F.concat_ws("|", F.lit(table_name), F.lit(query_column), _cell(query_column), *[F.concat(F.lit(f"{c}="), _cell(c)) for c in sorted(context_columns)])


def _or_missing(c: Column) -> Column:
    return F.when(c == "", F.lit(MISSING)).otherwise(c)


def table_prompt(table_name: str, query_column: str, context_columns: Sequence[str], value: Values = _cell) -> Column:
    """Prompt of the production run: table, query, list of context columns, their values."""
    lines = [
        F.lit(f"Table name: {table_name or 'unknown table'}"),
        F.lit(f"Query column: {query_column}"),
        F.concat(F.lit("Query value: "), _or_missing(value(query_column))),
        F.lit(f"Context columns: {', '.join(context_columns) or 'none'}"),
        F.lit("Context values:"),
        *([F.concat(F.lit(f"- {c}: "), _or_missing(value(c))) for c in context_columns] or [F.lit("- none")]),
    ]
    return F.concat_ws("\n", *lines)


def named_prompt(columns: Sequence[str], query_column: str, context_columns: Sequence[str], value: Values = _cell) -> Column:
    lines = [
        F.lit(f"Query column: {query_column}"),
        F.concat(F.lit("Query value: "), _or_missing(value(query_column))),
        F.lit("Context values:"),
        *([F.concat(F.lit(f"- {c}: "), _or_missing(value(c))) for c in context_columns] or [F.lit("- none")]),
    ]
    return F.concat_ws("\n", *lines)


def values_prompt(columns: Sequence[str], query_column: str, context_columns: Sequence[str], value: Values = _cell) -> Column:
    found = [F.when(value(c) != "", value(c)) for c in (query_column, *context_columns)]
    return _or_missing(F.concat_ws("\n", *found))


def full_row_prompt(columns: Sequence[str], query_column: str, context_columns: Sequence[str], value: Values = _cell, include_names: bool = True) -> Column:
    lines = [F.when(value(c) != "", F.concat(F.lit(f"{c}: " if include_names else ""), value(c))) for c in columns if c not in DERIVED]
    return _or_missing(F.concat_ws("\n", *lines))


PROMPTS = {"named": named_prompt, "values_only": values_prompt, "full_row": full_row_prompt}
SHOTS = ("zero_shot", "few_shot")


def prompt(kind: str, columns: Sequence[str], query_column: str, context_columns: Sequence[str], value: Values = _cell) -> Column:
    if kind not in PROMPTS:
        raise ValueError(f"unknown prompt type {kind!r}; known: {sorted(PROMPTS)}")
    return PROMPTS[kind](columns, query_column, context_columns, value)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def table_examples(table_name: str, query_column: str, context_columns: Sequence[str]) -> list[Column]:
    """User and assistant turns of the worked examples, with their values put by position on the context columns
    (missing ones empty, surplus ones left out)."""
    out = []
    for e in EXAMPLES:
        given = [e["spec_type_desc"], e["org_name"], e["ab_name"]]
        cells = {c: given[i] if i < len(given) else "" for i, c in enumerate(context_columns)} | {query_column: e["test_name"]}
        out.append(message("user", table_prompt(table_name, query_column, context_columns, lambda c, cells=cells: F.lit(cells[c]))))
        out.append(message("assistant", F.lit(e["ideal_description"])))
    return out


def experiment_examples(kind: str, query_column: str, context_columns: Sequence[str]) -> list[Column]:
    """The same turns with the examples' own column names, for prompt experiments; the query column must be one of them."""
    out = []
    for e in EXAMPLES:
        if kind in ("named", "values_only") and query_column not in e:
            raise KeyError(query_column)
        known = [c for c in context_columns if c in e]
        columns = [c for c in e if c != "ideal_description"] if kind == "full_row" else list(e)
        out.append(message("user", prompt(kind, columns, query_column, known, lambda c, e=e: F.lit(e[c]))))
        out.append(message("assistant", F.lit(e["ideal_description"])))
    return out


def messages(user: Column, examples: Sequence[Column] = (), system: str = SYSTEM_PROMPT) -> Column:
    """System, examples, user, as an array of role and content."""
    return F.array(message("system", F.lit(system)), *examples, message("user", user))
