"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record's nested field paths are hashed; the hash selects a declarative mapping that turns its layout into canonical
turns.  The template marks turns with control strings, and the same strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates, escaped inside texts.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """``paths``: the field paths that it fits, sorted; ``turns``: SQL from the variant ``v`` to an array of turns."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.paths).encode()).hexdigest()


#: The layouts of a turn within a list: its field paths and its role and text fields.
_TURN_FIELDS = {"content": ("role", "content"), "text": ("role", "text"), "value": ("from", "value")}


def _list(path: str, role: str, text: str) -> str:
    return f"transform(variant_get(v, '$.{path}', 'array<variant>'), m -> named_struct('role', try_variant_get(m, '$.{role}', 'string'), 'text', try_variant_get(m, '$.{text}', 'string')))"


def _mixed(path: str, kinds: tuple[str, ...]) -> Mapping:
    """A list whose turns have different layouts, each read by the one whose fields it has; null when a turn fits none or several."""
    fields = sorted({f for k in kinds for f in _TURN_FIELDS[k]})
    have = {f: f"try_variant_get(m, '$.{f}', 'variant') is not null" for f in fields}
    fits = {k: " and ".join(have[f] if f in _TURN_FIELDS[k] else f"not ({have[f]})" for f in fields) for k in kinds}
    turn = lambda k: "named_struct('role', try_variant_get(m, '$.{}', 'string'), 'text', try_variant_get(m, '$.{}', 'string'))".format(*_TURN_FIELDS[k])
    list_ = f"variant_get(v, '$.{path}', 'array<variant>')"
    cases = " ".join(f"when {fits[k]} then {turn(k)}" for k in kinds)
    turns = f"if(forall({list_}, m -> {' or '.join(f'({f})' for f in fits.values())}), transform({list_}, m -> case {cases} end), null)"
    return Mapping(f"{path}_mixed_{'_'.join(kinds)}", tuple(f"{path}[].{f}" for f in fields), turns)


def _pairs(*pairs: tuple[str, str]) -> str:
    turns = ", ".join(f"named_struct('role', '{role}', 'text', try_variant_get(v, '$.{path}', 'string'))" for role, path in pairs)
    return f"array({turns})"


def _wrapped(name: str, *pairs: tuple[str, str]) -> list[Mapping]:
    """The layouts that have some of the texts in an object's only field, text or content."""
    out = []
    for ends in itertools.product(("", ".text", ".content"), repeat=len(pairs)):
        if any(ends):
            paths = [(role, path + end) for (role, path), end in zip(pairs, ends)]
            out.append(Mapping(f"{name}_wrapped", tuple(sorted(p for _, p in paths)), _pairs(*paths)))
    return out


_INSTRUCTION = "concat_ws('\n\n', try_variant_get(v, '$.instruction', 'string'), nullif(try_variant_get(v, '$.input', 'string'), ''))"
#: Fields named id, source, meta or metadata never count.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Mapping("messages_text", ("messages[].role", "messages[].text"), _list("messages", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
    Mapping("turns", ("turns[].role", "turns[].text"), _list("turns", "role", "text")),
    Mapping("prompt_completion", ("completion", "prompt"), _pairs(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), _pairs(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), _pairs(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), _pairs(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction_output", ("instruction", "output"), _pairs(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction_input_output",
        ("input", "instruction", "output"),
        f"array(named_struct('role', 'user', 'text', {_INSTRUCTION}), named_struct('role', 'assistant', 'text', try_variant_get(v, '$.output', 'string')))",
    ),
    *(_mixed(path, kinds) for path in ("messages", "conversations", "turns") for n in (2, 3) for kinds in itertools.combinations(_TURN_FIELDS, n)),
    *_wrapped("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    *_wrapped("prompt_response", ("user", "prompt"), ("assistant", "response")),
    *_wrapped("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    *_wrapped("question_answer", ("user", "question"), ("assistant", "answer")),
    *_wrapped("instruction_output", ("user", "instruction"), ("assistant", "output")),
)
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
_ASIDE = ("id", "source", "meta", "metadata")


#: A key with its colon, another string, a bracket or an empty pair of them, another scalar; JSON that Spark has written has no blanks between.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+":?|\{\}|\[\]|[\{\}\[\]]|[^",:\{\}\[\]]+'


def _paths(column: str) -> Column:
    """The distinct paths of a JSON text, sorted: of every field at every depth, and of all elements of each list.

    Scalars of any type give the same path, so records differ by layout, not by values. Empty lists and lists of
    scalars end in [], empty objects in {}; keys are as JSON writes
    them, with a backslash before each dot, bracket and backslash.
    """
    tokens = F.regexp_extract_all(F.expr(f"to_json(try_parse_json({column}))"), F.lit(_JSON_TOKEN), F.lit(0))
    state = lambda open_, at, paths: F.struct(open_.alias("open"), at.alias("at"), paths.alias("paths"))
    texts = F.array().cast("array<string>")
    top = lambda open_: F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit(""))

    def step(s: Column, t: Column) -> Column:
        first, here = F.substring(t, 1, 1), top(s["open"])
        key = F.regexp_replace(t.substr(F.lit(2), F.length(t) - 3), r"([.\[\]{}\\])", r"\\$1")
        popped = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        leaf = F.concat(s["at"], F.when(t.isin("{}", "[]"), t).otherwise(""))
        return (
            F.when(t.endswith(":") & (first == '"'), state(s["open"], F.concat(here, F.when(here == "", "").otherwise("."), key), s["paths"]))
            .when(t == "{", state(F.concat(s["open"], F.array(s["at"])), s["at"], s["paths"]))
            .when(t == "[", state(F.concat(s["open"], F.array(F.concat(s["at"], F.lit("[]")))), F.concat(s["at"], F.lit("[]")), s["paths"]))
            .when(t.isin("}", "]"), state(popped, top(popped), s["paths"]))
            .otherwise(state(s["open"], here, F.array_union(s["paths"], F.array(leaf))))
        )

    found = F.aggregate(F.coalesce(tokens, texts), state(texts, F.lit(""), texts), step, lambda s: s["paths"])
    aside = rf"^(?:{'|'.join(_ASIDE)})(?:[.\[{{]|$)"
    return F.array_sort(F.filter(found, lambda p: ~p.rlike(aside) & (p != "{}")))


def canonical_turns(df: DataFrame, record: str, out: str = "turns", rename: bool = True) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``out``, the canonical turns of the JSON texts in ``record``.

    The fingerprint is the SHA-256 of the record's sorted field paths, one to a line. A record whose fingerprint no
    mapping has, an unreadable one and a null one have a null layout and null turns; roles are lower-cased and other
    layouts' names for user and assistant replaced unless ``rename`` is false; null texts become empty.
    """
    shaped = df.withColumn("fingerprint", F.when(F.col(record).isNotNull(), F.sha2(F.array_join(_paths(f"`{record}`"), "\n"), 256)))
    v = f"try_parse_json(`{record}`)"
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        here = F.col("fingerprint") == m.fingerprint
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, F.expr(m.turns.replace("(v, ", f"({v}, ")).cast(TURNS)).otherwise(turns)
    roles = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    named = lambda r: F.coalesce(F.try_element_at(roles, F.lower(r)), F.lower(r)) if rename else r
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(named(t["role"]), F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return shaped.withColumn("layout", layout).withColumn(out, clean)


def _control_pattern() -> str:
    """The first character of any control string, where one starts."""
    special = r"\^$.|?*+()[]{}"
    quote = lambda s: "".join("\\" + c if c in special else c for c in s)
    by_head: dict[str, list[str]] = {}
    for c in CONTROLS:
        by_head.setdefault(c[0], []).append(c[1:])
    return "|".join(f"({quote(h)})(?=(?:{'|'.join(map(quote, tails))}))" for h, tails in by_head.items())


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string, so that none is left."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    groups = "".join(f"${k + 1}" for k in range(len({c[0] for c in CONTROLS})))
    return F.regexp_replace(doubled, _control_pattern(), groups + r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "\\\\\\\n")


def render(turns: Column, trained: str = "assistant") -> tuple[Column, Column]:
    """(text, loss runs): a run for each turn says how many characters of it come before the loss mask and how many are under it."""
    made = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("on")))
    text = F.array_join(F.transform(made, lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    runs = F.transform(made, lambda m: F.struct(F.char_length(m["head"]).alias("skip"), F.when(m["on"], F.char_length(m["body"])).otherwise(0).alias("keep")))
    return text, runs


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: the inverse of ``render``."""
    quoted = END.replace("|", r"\|") + "\n"
    pieces = F.filter(F.split(formatted, quoted), lambda p: p != "")
    head = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def under_mask(formatted: Column, runs: Column) -> Column:
    """All text under the loss mask, unescaped: each trained turn once, in order, nothing between."""
    pieces = F.filter(F.split(formatted, END.replace("|", r"\|") + "\n"), lambda p: p != "")
    kept = F.zip_with(pieces, runs, lambda p, r: F.when(r["keep"] > 0, F.substring(p, r["skip"] + 1, r["keep"])).otherwise(""))
    return unescape(F.array_join(kept, ""))


def conversations_to_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) from one row for each turn: the layout whose records are spread over rows.

    Turns go by number, null first; turns that share a number by role and text; repeated rows stay. Null roles and
    texts are empty, null conversation ids are one conversation. One conversation is one value, so its rows meet.
    """
    row = F.struct(F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    together = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return together.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def conversations_to_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record) from one row for each turn: each conversation as a JSON record of the layout ``turns``."""
    return conversations_to_turns(rows, conv_id, turn, role, text).select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def format_chat(turns: DataFrame, column: str = "turns", trained: str = "assistant") -> DataFrame:
    """``turns`` with ``formatted`` and ``loss_runs``; null turns stay null, no turns give an empty text."""
    text, runs = render(F.col(column), trained)
    return turns.withColumns({"formatted": text, "loss_runs": runs})


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted text and its mask hold, read back from them alone."""
    back = formatted.select(key, "formatted", read_back(F.col("formatted")).alias("back"), under_mask(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    flat = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )

