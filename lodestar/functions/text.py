"""Column functions over questions and SQL texts: normal forms, skeletons, extraction from model output. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a skeleton masks, and the masks.
QUOTED, AMOUNT = r"'[^']*'", r"\$?\d[\d,.:-]*"
MASKS = {"quoted": "<s>", "amount": "<n>", "vocabulary": "<v>"}
#: Quoted texts (doubled quotes inside) and comments.
LITERAL = r"'(?:[^']|'')*'"
COMMENT = r"--[^\n]*|(?s:/\*.*?\*/)"


def normal_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_paraphrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def skeleton(text: Column, vocabulary: tuple[str, ...] = ()) -> Column:
    """The question with quoted texts, numbers and the words of a vocabulary masked: equal skeletons differ only in parameters."""
    s = F.lower(text)
    for pattern, mask in ((QUOTED, "quoted"), (AMOUNT, "amount")):
        s = F.regexp_replace(s, pattern, MASKS[mask])
    if vocabulary:
        longest = sorted((v.lower() for v in vocabulary), key=lambda v: (-len(v), v))
        s = F.regexp_replace(s, r"\b(?:" + "|".join(f"\\Q{v}\\E" for v in longest) + r")\b", MASKS["vocabulary"])
    return normal_question(s)


def masked_sql(sql: Column) -> Column:
    """SQL with literals and numbers as ?, comments and space squeezed, in lower case."""
    s = F.regexp_replace(F.regexp_replace(sql, COMMENT, " "), LITERAL, "?")
    return normal_question(F.lower(F.regexp_replace(s, r"\b[0-9]+(?:\.[0-9]+)?\b", "?")))


def without_thinking(text: Column) -> Column:
    """Closed blocks go; so does all before a stray closing tag and all after an open one."""
    s = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?is)^.*</think>", ""), r"(?is)<think>.*$", "")


IS_QUERY = r"(?i)^(?:SELECT|WITH)\b"


def last_query(text: Column) -> Column:
    """The last of the statements that is a query, without leading comments and the semicolon; null if none is."""
    split = F.split(text, r";(?=(?:[^']*'[^']*')*[^']*$)")
    bare = F.transform(split, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)^(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)+", ""), r"\s+$", "")))
    return F.get(F.reverse(F.filter(bare, lambda s: s.rlike(IS_QUERY))), F.lit(0))


def extract_sql(output: Column) -> Column:
    """The SQL in a model's answer: the last fenced block that holds a query, else what follows an open fence, else the last paragraph from its SELECT or WITH on."""
    text = without_thinking(output)
    first = lambda found: F.get(F.filter(F.reverse(found), lambda x: x.isNotNull()), F.lit(0))
    fenced = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```")), last_query)
    n_fences = F.size(F.split(text, "```")) - 1
    dangling = F.when(n_fences % 2 == 1, last_query(F.regexp_extract(text, r"(?s)^.*```[^\n]*\n(.*)$", 1)))
    loose = F.split(F.regexp_replace(text, r"(?s)```[^\n`]*\n.*?```", "\n\n"), r"\n\s*\n")
    query = r"select\s.*|with\s[^;]*?\bas\s*\(.*"  # a WITH counts where it names a query
    begins = lambda chunk, before: F.nullif(F.regexp_extract(chunk, rf"(?ims){before}({query})\z", 1), F.lit(""))
    from_query = lambda chunk: last_query(F.coalesce(begins(chunk, "^[ \\t]*"), begins(chunk, r"\b")))  # noqa: E731  one that starts a line goes first
    return F.coalesce(first(fenced), dangling, first(F.transform(loose, from_query)))


def task_id(family: Column, sql: Column) -> Column:
    return F.concat(F.lit("sql-"), F.substring(F.sha2(F.concat_ws("|", family, sql), 256), 1, 12))


def chat_row(system: Column, question: Column, answer: Column) -> Column:
    """The messages of a training row."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", question), turn("assistant", answer))


def blended_cost(student: Column, teacher: Column, deferred: Column) -> Column:
    """Cost of a request when a share of them is deferred: the student always answers first."""
    return student + deferred * teacher


def break_even(fixed: Column, student: Column, teacher: Column, deferred: Column) -> Column:
    """Requests after which a fixed cost is saved; null if it never is."""
    saved = teacher - blended_cost(student, teacher, deferred)
    return F.when(saved > 0, F.ceil(fixed / saved))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def unit(vector: Column, dims: int) -> Column:
    """The first dims numbers of a vector scaled to length 1, as floats; a vector that has no length, or one that isn't finite, is an error."""
    cut = F.slice(vector, 1, dims)
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    good = (norm > 0) & (norm < F.lit(float("inf")))  # NaN is above infinity
    return F.when(good, F.transform(cut, lambda x: (x / norm).cast("float"))).otherwise(F.raise_error(F.lit("a vector without direction")).cast("array<float>"))


def answer_log_probs(tokens: Column, logs: Column, stop: int, think_end: int) -> Column:
    """(mean, least, n) of the log-probabilities of an answer's tokens: from after the last think_end up to the first stop; nulls where none is left."""
    end = F.array_position(tokens, F.lit(stop))
    kept = F.when(end > 0, F.slice(tokens, 1, end - 1)).otherwise(tokens)
    after = F.coalesce(F.array_max(F.transform(kept, lambda t, i: F.when(t == think_end, i + 1))), F.lit(0)).cast("int")
    mine = F.slice(logs, after + 1, F.greatest(F.size(kept) - after, F.lit(0)))
    total = F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(F.when(F.size(mine) > 0, total / F.size(mine)).alias("mean"), F.array_min(mine).alias("least"), F.size(mine).alias("n"))


def frames(event_id: Column, event: Column, data: Column) -> Column:
    """Server-sent event frames: id, event, and a data line for each line of data."""
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
