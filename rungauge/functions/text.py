"""Text expressions: blanks, fences, tool calls, actions.  All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the chat protocol -----------------------------------------
# Blanks as the protocol's reader counts them: Unicode white space and the four
# information separators.
BLANK = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"
SUBMIT_MARKER = "COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT"
SUBMIT_FENCE = "```bash\necho COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT\n```"
FORMAT_ERROR_PREFIX = "Format error:"
COMPACT_MARK = "Here is the conversation so far"
POST_MARK = "What did we do so far?"
TASK_MARK = "<pr_description>"
STATEMENT_MARK = "Consider the following PR description:"
STATEMENT_END = "</pr_description>"
FENCE = r"(?s)```(?:bash|mswea_bash_command)[^\S\n]*\n(.*?)\n?```"
NATIVE_CALL = r"(?s)<function\s+name=\"([^\"]*)\"\s*>(.*?)</function\s*>"
SHELL_NAMES = [
    "bash", "sh", "shell", "exec", "execute", "execute_bash", "code_exec", "run", "run_bash",
    "command", "terminal",
]
COMMAND_PARAMS = ["command", "cmd", "script", "command_line", "commands", "input"]
TAG_LINE = (
    r"^\s*(?:</?[A-Za-z_][A-Za-z0-9_:-]*(?:\s[^>\n]*)?>|</?｜｜DSML｜｜[^>\n]*>|</?｜[^>\n]*>)\s*$"
)
THOUGHT_TAG = r"</?THOUGHT>|<parameter name=\"THOUGHT\">"
JUNK_IN_COMMAND = r"</?parameter|DSML|</?invoke|</?antml"
DSML_START = "<｜｜DSML｜｜"
DSML_COMMAND = r'(?s)<｜｜DSML｜｜ parameter name="command"[^>]*>(.*?)</｜｜DSML｜｜ parameter>'
# --- end of fixed values --------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable: the value is computed once per row.

    Used as a plain expression, a value that appears n times is evaluated n times,
    because regular expressions and array functions share no results.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends freed of blanks."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANK_CHARACTERS))


def one_blank(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, rf"[{BLANK}]+", " "))


def lines(text: Column) -> Column:
    """Array of lines."""
    return F.split(text, r"\r\n|\r|\n")


def all_matches(text: Column, pattern: str, group: int) -> Column:
    """Every match of one group, an empty array when there is none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def unwrap_cdata(value: Column) -> Column:
    """The inside of a value that is one CDATA section, else the value."""
    wrapped = r"(?s)\A\s*<!\[CDATA\[(.*?)\]\]>\s*\z"
    return F.when(value.rlike(wrapped), F.regexp_extract(value, wrapped, 1)).otherwise(value)


def _param(body: Column, name: str) -> Column:
    """Value of the last parameter with this name, null when absent."""
    pattern = rf"(?s)<param\s+name=\"\s*{name}\s*\"\s*>(.*?)</param\s*>"
    found = all_matches(body, pattern, 1)
    return unwrap_cdata(F.try_element_at(found, F.lit(-1)))


def native_calls(text: Column) -> Column:
    """Array of (name, command): command is null for a tool that is no shell call."""
    names = all_matches(text, NATIVE_CALL, 1)
    bodies = all_matches(text, NATIVE_CALL, 2)
    bare = r"(?s)\A\s*<!\[CDATA\[(.*?)\]\]>\s*\z"

    def call(name: Column, body: Column) -> Column:
        bare_value = F.when(
            body.rlike(bare) & (F.length(strip(F.regexp_extract(body, bare, 1))) > 0),
            F.regexp_extract(body, bare, 1),
        )
        command = F.coalesce(*[_param(body, p) for p in COMMAND_PARAMS], bare_value)
        name = strip(name)
        return F.struct(name.alias("name"), F.when(name.isin(SHELL_NAMES), command).alias("command"))

    return F.zip_with(names, bodies, call)


def parse_action(text: Column) -> Column:
    """struct(action, kind): the single shell action of a reply.

    kind is ``ok``, ``none``, ``many`` or ``unavailable`` (only calls of tools
    that do not exist); action is null unless ok.
    """

    def found(t: Column) -> Column:
        # The plain searches keep the regular expressions off texts without markup.
        fences = F.when(F.contains(t, F.lit("```")), all_matches(t, FENCE, 1)).otherwise(
            F.array().cast("array<string>")
        )
        calls = F.when(F.contains(t, F.lit("<function")), native_calls(t)).otherwise(
            F.array().cast("array<struct<name:string,command:string>>")
        )
        return F.struct(fences.alias("fences"), calls.alias("calls"))

    def counted(v: Column) -> Column:
        shell = F.filter(v["calls"], lambda c: c["command"].isNotNull())
        return F.struct(
            F.concat(v["fences"], F.transform(shell, lambda c: c["command"])).alias("actions"),
            F.size(F.filter(v["calls"], lambda c: c["command"].isNull())).alias("others"),
        )

    def judged(v: Column) -> Column:
        n = F.size(v["actions"])
        ok = (n == 1) & (v["others"] == 0)
        kind = (
            F.when(ok, F.lit("ok"))
            .when((n == 0) & (v["others"] > 0), F.lit("unavailable"))
            .when((n + v["others"]) == 0, F.lit("none"))
            .otherwise(F.lit("many"))
        )
        action = F.when(ok, strip(F.try_element_at(v["actions"], F.lit(1))))
        return F.struct(action.alias("action"), kind.alias("kind"))

    return let(let(let(text, found), counted), judged)


def is_submission(text: Column) -> Column:
    """First non-blank line is the submit marker."""
    return strip(F.substring_index(lstrip(text), "\n", 1)) == F.lit(SUBMIT_MARKER)


def prompt_key(text: Column) -> Column:
    """md5 of a prompt after undoing a re-quoted command line message."""
    t = strip(text)
    quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('\\"'), F.lit('"'))
    return F.md5(strip(F.when(quoted, inner).otherwise(t)))


def estimated_tokens(text: Column) -> Column:
    """int(characters / 3.7 + 0.5)."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.7) + F.lit(0.5)).cast("long")


def clip_note(omitted: Column) -> Column:
    return F.concat(F.lit("...[truncated "), omitted.cast("string"), F.lit(" chars: tool output limit]"))


def bare_json(text: Column) -> Column:
    """JSON text with its strings emptied, so that brackets and commas are only structure."""
    return F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', '""')


def json_depth(text: Column) -> Column:
    """How much deeper a piece of JSON text ends than it begins."""
    bare = bare_json(text)
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object from its first character to its last, without repeated keys.

    A parser that stops after the first value does not see what follows it, so
    the brackets are followed: they may close to nothing once, at the end.
    """
    brackets = F.regexp_extract_all(bare_json(text), F.lit(r"[{}\[\]]"), F.lit(0))

    def follow(state: Column, b: Column) -> Column:
        depth = state["depth"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (state["closed"] + (depth == 0).cast("int")).alias("closed"))

    end = F.aggregate(brackets, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")), follow)
    shape = strip(text).startswith("{") & strip(text).endswith("}")
    return F.coalesce(shape & F.try_parse_json(text).isNotNull() & (end["depth"] == 0) & (end["closed"] == 1), F.lit(False))
