"""Rules on texts as Columns: what marks an admission, noise, a search command, a leak, and what is cut from tool answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which an assistant or its user admits a mistake.
ADMISSIONS = (
    "i mistakenly", "i incorrectly", "my mistake", "i was wrong", "that was wrong", "i shouldn't have", "i should not have", "i made a mistake", "i made an error",
    "let me fix that", "let me correct", "my apologies", "i apologise", "i apologize", "that's not right", "that isn't right", "no, don't", "no, do not", "you broke",
    "don't do that", "my bad", "my error", "i misread", "i misunderstood", "i misdiagnosed", "i conflated", "i overlooked", "i missed that", "i got that wrong",
    "got it wrong", "i jumped the gun", "i overcorrected", "over-cautious", "i forgot to", "i neglected to", "i failed to", "i corrupted", "corrupted the", "i broke",
    "that broke", "i clobbered", "i overwrote", "self-inflicted", "i introduced a", "that introduced a", "i realise i", "i realised i", "i realize i", "i realized i",
    "scratch that", "disregard that", "correction:", "let me revert", "let me redo", "let me undo", "reverting", "i should have used", "you're right", "you are right",
    "you're correct", "you are correct", "good catch",
)
#: How a distiller's own prompts begin.
DISTILLER_PROMPTS = ("You extract durable long-term memory", "Summarise this coding-assistant session", "You are consolidating long-term memory", "You review a coding-assistant session")
#: How user turns begin that the harness wrote.
HARNESS = ("<local-command", "<command-name>", "<command-message>", "<command-args>", "<ide_opened_file>", "<user-", "caveat:", "[request interrupted", "base directory for this skill")
#: How lines begin that are no prose.
NO_PROSE = ("http", "```", "|", ">", "<")
#: How a line begins that asks for something.
ASKS = (
    "can we", "can you", "could you", "would you", "should i", "should we", "what does", "what is", "what's", "how do", "how does", "why is", "why do", "please ", "let's ", "lets ",
    "yes", "okay", "ok ", "one other", "note,", "note ",
)
#: How a line begins in which an assistant talks about its own work.
NARRATION = (
    "let me", "let us ", "i'll ", "i will ", "i'm going to", "i am going to", "i've ", "i have ", "now i", "now let", "first, i", "first i", "next, i", "next i", "then i", "here's ",
    "here is ", "the assistant ", "we now ", "we can now",
)
#: Words of facts about measurements, which don't belong in a test corpus.
CONTAMINATION = (
    "recall@", "mrr", "benchmark", "whitepaper", "dataset.json", "wilson", "run_eval", "bench/", "paraphrase", "confidence interval", "counterfactual", "wilcoxon", "mcnemar", "bootstrap",
    "bake-off", "bakeoff", "matryoshka", "hard negative", "hard-negative", "multi-relevant", "corpus", "paired", "a/b", "replay", "arctic", "mxbai", "nomic",
)
#: Patterns of addresses, of what looks like a credential, and of paths in home folders.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
SECRET = r"(?i)(api[_-]?key|secret|token|password|bearer|aws_|sk-[A-Za-z0-9]{8,})"
HOME_PATH = r"""/(?:Users|home)/[\w.-]+/[^\s'"]*"""
#: Patterns of commands that search files: tools made for it, grep through folders, find by name.
SEARCH_TOOL, GREP, GREP_FLAGS, FIND, FIND_FLAGS = r"(?:^|[|&;]\s*|\s)(?:rg|ag|ack)\b", r"\be?grep\b", r"(?:-[A-Za-z]*[rR]\b|--include|--exclude)", r"\bfind\b", r"-(?:i?name|i?path|regex)\b"
#: What follows a tool's name in a command that removes a plugin with its data, and the flag that keeps the data.
REMOVAL, KEEP_DATA = r"\s+plugins?\s+(?:uninstall|remove)\b", r"--keep-data\b"
#: A line that names a page's address, and any address.
URL_LINE, URL_ANY = r"(?im)^\s*-?\s*(?:page\s+url|url)\s*[:=]\s*(\S+)", r"(https?://\S+)"


def _begins(text: Column, starts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for s in starts:
        hit = hit | text.startswith(s)
    return hit


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def has_admission(text: Column) -> Column:
    return _holds(F.lower(F.coalesce(text, F.lit(""))), ADMISSIONS)


def is_distiller_prompt(text: Column) -> Column:
    return _begins(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 120), DISTILLER_PROMPTS)


def is_harness(text: Column) -> Column:
    """Whether a user turn is scaffolding and not something that a user said."""
    return _begins(F.substring(F.lower(F.regexp_replace(text, r"^\s+", "")), 1, 40), HARNESS)


def is_ask(line: Column) -> Column:
    return line.endswith("?") | _begins(F.lower(line), ASKS)


def is_narration(line: Column) -> Column:
    return line.endswith(":") | _begins(F.lower(line), NARRATION)


def contamination(text: Column) -> Column:
    """The first of the words that a text holds; null if there is none."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(w), w) for w in CONTAMINATION))


def privacy_flags(text: Column, own: str = "") -> Column:
    """email, credential-shaped, and the first path in a home folder outside `own`, of each that a text holds."""
    paths = F.regexp_extract_all(text, F.lit(f"({HOME_PATH})"), 1)
    other = F.get(F.filter(paths, lambda p: ~p.startswith(own)) if own else F.filter(paths, lambda p: F.lit(False)), F.lit(0))
    found = F.array(F.when(text.rlike(EMAIL), "email"), F.when(text.rlike(SECRET), "credential-shaped"), F.when(other.isNotNull(), F.concat(F.lit("non-repo path: "), F.substring(other, 1, 60))))
    return F.filter(found, lambda f: f.isNotNull())


def is_file_search(command: Column) -> Column:
    """Whether a shell command looks through files, and isn't a filter of a pipe."""
    c = F.coalesce(command, F.lit(""))
    return c.rlike(SEARCH_TOOL) | (c.rlike(GREP) & c.rlike(GREP_FLAGS)) | (c.rlike(FIND) & c.rlike(FIND_FLAGS))


def removes_data(command: Column, tool: str, plugin: str) -> Column:
    """Whether a shell command has the tool remove the plugin and its data."""
    c = F.coalesce(command, F.lit(""))
    return c.rlike(rf"(?i)\b{tool}{REMOVAL}") & ~c.rlike(KEEP_DATA) & F.lower(c).contains(plugin.lower())


def anchor_matches(anchor: Column, gold: Column) -> Column:
    """Whether an anchor is the wanted one, or ends in its last name."""
    a, g = F.lower(anchor), F.lower(gold)
    return (a == g) | a.endswith(F.concat(F.lit("."), F.element_at(F.split(g, r"\."), -1)))


def soft_trim(text: Column, most: int = 400) -> Column:
    """Cut between words, with an ellipsis, where a text is longer."""
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    whole = F.regexp_replace(F.substring(t, 1, most), r"\s+\z", "")
    head = F.regexp_replace(F.regexp_replace(whole, r"\s+\S+\z", ""), r"[ ,;:—-]+\z", "")
    return F.when(F.length(t) <= most, t).otherwise(F.when(head != "", F.concat(head, F.lit("…"))).otherwise(whole))


def rule_text(rule: Column, most: int = 400) -> Column:
    """The line of an anti-pattern: its rule without full stops at the end."""
    return soft_trim(F.regexp_replace(F.regexp_replace(rule, r"\A\s+|\s+\z", ""), r"\.+\z", ""), most)


def _kind(v: Column) -> Column:
    """array, object, string or another word for what a VARIANT holds."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").otherwise("other")


def _as(path: str, v: Column, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _listed(v: Column) -> Column:
    """The texts of a list's objects, where they are strings."""
    texts = F.transform(v, lambda b: F.when((_kind(b) == "object") & (_kind(_as("$.text", b, "variant")) == "string"), _as("$.text", b)))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")


def result_text(response: Column) -> Column:
    """The text of a tool's answer: a list of blocks, an object with a list `content`, one of four fields that are strings, a JSON string, or a text that is no JSON.

    What parses as JSON counts as JSON, so a text that only begins like it is a text.
    """
    v = F.try_parse_json(response)
    content = _as("$.content", v, "variant")
    field = lambda k: F.when(_kind(_as(f"$.{k}", v, "variant")) == "string", _as(f"$.{k}", v))
    of_object = F.when(_kind(content) == "array", _listed(F.try_variant_get(content, "$", "array<variant>"))).otherwise(F.coalesce(*map(field, ("text", "result", "output", "stdout")), F.lit("")))
    kind = _kind(v)
    return (
        F.when(response.isNull(), "").when(v.isNull(), response).when(kind == "array", _listed(F.try_variant_get(v, "$", "array<variant>"))).when(kind == "object", of_object)
        .when(kind == "string", _as("$", v)).otherwise(F.when(F.trim(response) == "null", "").otherwise(response))
    )


def result_bytes(content: Column) -> Column:
    """UTF-8 bytes of the content of a tool's result (its JSON): of a string, or of the texts of a list's objects; a text that is no JSON counts as a string."""
    v = F.try_parse_json(content)
    shown = lambda b: F.coalesce(_as("$.text", b), F.when(_as("$.text", b, "variant").isNotNull(), F.to_json(_as("$.text", b, "variant"))), F.lit(""))
    texts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.when(_kind(b) == "object", F.octet_length(shown(b))).otherwise(0))
    listed = F.aggregate(texts, F.lit(0), lambda a, b: a + b)
    kind = _kind(v)
    return F.when(content.isNull(), 0).when(v.isNull(), F.octet_length(content)).when(kind == "string", F.octet_length(_as("$", v))).when(kind == "array", listed).otherwise(F.lit(0))


def page_url(text: Column) -> Column:
    """The address that a line of a page's snapshot names, else the first in its first 2000 characters; null if there is none."""
    named, any_ = F.regexp_extract(text, URL_LINE, 1), F.regexp_extract(F.substring(text, 1, 2000), URL_ANY, 1)
    bare = lambda u: F.regexp_replace(u, r"[.,);]+$", "")
    return F.when(named != "", bare(named)).when(any_ != "", bare(any_))


def longest_string(response: Column) -> Column:
    """Bytes of the longest string anywhere in a JSON object, list or string, or of a text that is none of these."""
    found = F.regexp_extract_all(response, F.lit(r'("(?:[^"\\]|\\.)*"(?:\s*:)?)'), 1)  # names of fields come with their colon
    strings = F.filter(found, lambda s: ~s.endswith(":"))
    plain = F.transform(strings, lambda s: F.octet_length(F.get_json_object(F.concat(F.lit('{"s":'), s, F.lit("}")), "$.s")))
    return F.when(F.coalesce(_kind(F.try_parse_json(response)), F.lit("")).isin("object", "array", "string"), F.coalesce(F.array_max(plain), F.lit(0))).otherwise(F.coalesce(F.octet_length(response), F.lit(0)))


def first_prose_line(title: Column, body: Column, most: int = 200) -> Column:
    """The first line of a section that is neither empty nor a list, table, quote or fence, without heading marks; else the title."""
    lines = F.transform(F.split(body, "\n"), lambda s: F.trim(F.ltrim(F.trim(s, F.lit(" \t\r")), F.lit("#")), F.lit(" \t\r")))
    good = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^(```|\||>|-|\*)"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), title), 1, most)


def embed_text(title: Column, heading_path: Column, summary: Column, body: Column, most: int = 1000) -> Column:
    """What of a chunk is embedded: where it stands, its summary and the head of its body; the title if all are empty."""
    t = F.regexp_replace(F.concat(F.coalesce(heading_path, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, most)), r"^\s+|\s+$", "")
    return F.when(t != "", t).otherwise(title)


def snapshot_title(url: Column) -> Column:
    return F.substring(F.when(F.coalesce(url, F.lit("")) != "", url).otherwise("page snapshot"), 1, 200)


def snapshot_summary(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s, F.lit(" \t"))), lambda s: s != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 200)
