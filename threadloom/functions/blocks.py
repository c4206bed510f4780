"""Content blocks of messages: serialisation, display, counting and meaning, as expressions.

A message's ``content`` is an array of blocks of the struct ``BLOCK``; ``kind`` says which fields
count: text, thinking, tool_call, tool_result, image or attachment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "struct<kind:string,text:string,call_id:string,name:string,arguments:string,is_error:boolean,media_type:string,filename:string,path:string,inlined_text:string,data:binary,signature:binary>"
CONTENT = f"array<{BLOCK}>"
#: Block kinds that each provider is sent; thinking of the first counts only where it is signed.
SENT = {
    "anthropic": ("text", "thinking", "tool_call", "tool_result"),
    "openai": ("text", "tool_call", "tool_result"),
    "ollama": ("text", "thinking", "tool_call", "tool_result"),
    "genai": ("text", "thinking", "tool_call", "tool_result"),
}
SIGNED_THINKING = ("anthropic",)


def _of(block: Column, name: str) -> Column:
    return F.coalesce(block[name], F.lit(""))


def _all(content: Column, piece) -> Column:
    return F.array_join(F.transform(F.coalesce(content, F.array().cast(CONTENT)), piece), "")


def shown(content: Column, kind: str = "text") -> Column:
    """Texts of the blocks of one kind with a blank line between them."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["kind"] == kind), lambda b: _of(b, "text")), "\n\n")


def calls(content: Column) -> Column:
    return F.filter(content, lambda b: b["kind"] == "tool_call")


def results(content: Column) -> Column:
    return F.filter(content, lambda b: b["kind"] == "tool_result")


def role_name(role: Column, other: str = "unknown") -> Column:
    return F.when(role.isin("user", "assistant", "system"), role).otherwise(other)


def has_meaning(content: Column) -> Column:
    """Whether a message says anything: text or thinking that is not empty."""
    return F.coalesce(F.exists(content, lambda b: b["kind"].isin("text", "thinking") & (_of(b, "text") != "")), F.lit(False))


def plain_text(content: Column) -> Column:
    """Every block as lines of text; attachments leave a marker and their inlined text, images nothing."""
    attached = lambda b: F.concat(F.lit("[attached: "), _of(b, "filename"), F.lit(" at "), _of(b, "path"), F.lit("]\n"), F.when(_of(b, "inlined_text") != "", F.concat(b["inlined_text"], F.lit("\n"))).otherwise(""))
    return _all(content, lambda b: F.when(b["kind"] == "attachment", attached(b)).otherwise(_line(b)))


def _line(b: Column) -> Column:
    line = F.concat(_of(b, "text"), F.lit("\n"))
    call = F.concat(_of(b, "name"), F.lit(": "), _of(b, "arguments"), F.lit("\n"))
    return F.when(b["kind"].isin("text", "thinking", "tool_result"), line).when(b["kind"] == "tool_call", call).otherwise("")


def counted_text(content: Column, provider: str) -> Column:
    """The text that a provider is really sent, on which budgets count."""
    sent = lambda b: b["kind"].isin(*SENT[provider])
    if provider in SIGNED_THINKING:
        signed = lambda b: (b["kind"] != "thinking") | (F.coalesce(F.octet_length(b["signature"]), F.lit(0)) > 0)
        kept = F.filter(content, lambda b: sent(b) & signed(b))
    else:
        kept = F.filter(content, sent)
    return _all(kept, _line)


def for_scoring(role: Column, content: Column) -> Column:
    """All blocks with labels of role and kind, the form in which stored messages are indexed."""

    def piece(b: Column) -> Column:
        named = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return (
            F.when(b["kind"] == "text", named("[text]\n", _of(b, "text"), "\n"))
            .when(b["kind"] == "thinking", named("[thinking]\n", _of(b, "text"), "\n"))
            .when(b["kind"] == "tool_call", named("[tool_call id=", _of(b, "call_id"), " name=", _of(b, "name"), "]\n", _of(b, "arguments"), "\n"))
            .when(b["kind"] == "tool_result", named("[tool_result tool_call_id=", _of(b, "call_id"), " error=", F.coalesce(b["is_error"], F.lit(False)).cast("string"), "]\n", _of(b, "text"), "\n"))
            .when(b["kind"] == "image", named("[image media_type=", _of(b, "media_type"), " bytes=", F.coalesce(F.octet_length(b["data"]), F.lit(0)).cast("string"), "]\n"))
            .when(b["kind"] == "attachment", named("[attachment filename=", _of(b, "filename"), " mime_type=", _of(b, "media_type"), " path=", _of(b, "path"), "]\n", _of(b, "inlined_text"), "\n"))
            .otherwise("")
        )

    return F.concat(F.lit("[message role="), role_name(role, "unspecified"), F.lit("]\n"), _all(content, piece), F.lit("[/message]\n"))


def for_query(role: Column, content: Column) -> Column:
    """Text and thinking alone, the form in which a message asks; empty where it says nothing."""
    said = F.filter(content, lambda b: b["kind"].isin("text", "thinking") & (_of(b, "text") != ""))
    body = _all(said, lambda b: F.concat(F.lit("["), b["kind"], F.lit("]\n"), b["text"], F.lit("\n")))
    whole = F.concat(F.lit("[message role="), role_name(role, "unspecified"), F.lit("]\n"), body, F.lit("[/message]\n"))
    return F.when(body == "", "").otherwise(whole)


def call_arguments(raw: Column) -> Column:
    """A call's arguments as a map; what is no JSON object is kept under ``raw``."""
    parsed = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(parsed.isNotNull() & F.trim(raw).startswith("{"), parsed).otherwise(F.create_map(F.lit("raw"), raw))


def schema_text(name: Column, description: Column, parameters: Column) -> Column:
    """A tool's declaration as JSON, whose estimated tokens a request pays for."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    given = F.when(F.coalesce(parameters, F.lit("")) == "", F.lit("{}")).otherwise(parameters)
    return F.concat(F.lit('{"type":"function","function":{"name":'), quoted(name), F.lit(',"description":'), quoted(description), F.lit(',"parameters":'), given, F.lit("}}"))
