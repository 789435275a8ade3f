"""Text and markup functions: Column in, Column out, all inside Catalyst.

Each takes time in proportion to its text, hostile ones too: white space at the ends is trimmed by sets of characters, and
what stands between two marks is found by places. A pattern that looks for a closing mark from every opening one only
runs on a text cut behind its last closing mark, where each search ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the formats and checks are defined by.
TOKEN = r"\\[a-zA-Z]+\*?|\\.|[{}()\[\]^_&+=\-*/<>|]|[a-zA-Z0-9]+|\S"
MAX_TOKENS = 1200
REFUSALS = ("please provide the image", "please attach", "no handwritten content provided", "i cannot see", "no image", "unable to process")
BUILD_REFUSALS = ("please provide the image", "no handwritten content", "please attach", "i cannot see")
REQUIRED_PACKAGES = ("amsmath", "amssymb", "amsfonts")
TRIGGERED_PACKAGES = {
    "cancel": (r"\cancel", r"\bcancel", r"\xcancel", r"\cancelto"),
    "mathtools": (r"\xmapsto", r"\coloneqq", r"\xLeftrightarrow"),
    "gensymb": (r"\degree", r"\celsius"),
    "textcomp": (r"\textcelsius",),
    "graphicx": (r"\includegraphics",),
    "enumitem": (r"\begin{enumerate}[",),
    "ulem": (r"\sout", r"\uline"),
}
DANGLING = r"(?:=|\\quad|\\to|\\Rightarrow|\+|-|\\\\)\s*$"
REVIEWED = "% REVIEWED: OK"
PREAMBLE = "\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\usepackage{amsfonts}\n\n\\begin{document}\n\n"
POSTAMBLE = "\n\n\\end{document}\n"
FURNITURE = r"(?iU)(?:Space\s+for\s+answering|Extra\s+space\s+for\s+answer|not\s+for\s+rough\s+work|Mention\s+Question\s+Number|^\s*\d+\s+of\s+\d+\s*$|^\s*Q\s*[-.\)①-⑳\d\?\s]{0,10}$)"
ERROR_CLASSES = (("backoff", ("429", "rate")), ("fatal", ("402", "insufficient", "credit")), ("fatal", ("401", "unauthorized")))
DROPPED_REGIONS = ("header", "footer", "page_number", "page-number", "pagenumber")
DET = r"(?i)<\|det\|>\s*([a-zA-Z_\-]+)\s*\[[0-9,\s]*\]\s*<\|/det\|>"
#: Also fixed: the rewrites that drop differences of style, in order; the body of a document, fences, marks and math.
CANONICAL = (
    (r"\\[dt]frac", r"\\frac"),
    (r"\\(?:left|right|bigl|bigr|biggl|biggr|big|Big|bigg|Bigg)\b", ""),
    (r"\\(?:displaystyle|textstyle|scriptstyle)\b", ""),
    (r"(?U)\\(?:,|;|:|!|quad|qquad|enspace|thinspace|\s)", " "),
    (r"\\\\", " "),
    (r"\\(?:begin|end)\{(?:align|equation|gather|displaymath|math)\*?\}", ""),
    (r"\\[\[\]()]", ""),
    (r"\$", ""),
)
BEGIN, END = r"\begin{document}", r"\end{document}"
FENCE, FENCE_LABEL = "```", r"\A(?:latex|tex)"
ILLEGIBLE = (("\\text{", "}"), ("\\textit{", "}"), ("[", "]"))  # on one line, with the word in between
INLINE_MATH = r"\$[^$]+\$|\\\[[^\\]+\\\]"
ENV_BEGIN, ENV_END = r"\\begin\{[^}]+\}", r"\\end\{[^}]+\}"
THINK, THINK_END = "<think>", "</think>"
REGION, REGION_END = "<|det|>", "<|/det|>"
SPECIAL, PLACEHOLDER = r"<\|/?[a-z_]+\|>", r"!\[\]\(images/\d+\.jpg\)"
HEADING = r"(?m)^#{1,6}\s*"

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ENDS_OF_LINES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once: a plan that repeats an expression in each step of a chain grows without bound."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WHITE))


def behind(c: Column, piece: str) -> Column:
    """What stands behind the first piece; null where there is none."""
    return F.when(F.contains(c, F.lit(piece)), F.substring(c, F.instr(c, F.lit(piece)) + len(piece), F.length(c)))


def _cut_last(c: Column, mark: str) -> tuple[Column, Column]:
    """A text up to its last mark, a character, and what stands behind; up to there each search for a mark ends."""
    place = F.when(F.contains(c, F.lit(mark)), F.length(c) - F.length(F.substring_index(c, mark, -1))).otherwise(0)
    return F.substring(c, F.lit(1), place), F.substring(c, place + 1, F.length(c))


def _sub_closed(c: Column, pattern: str, by: str, closer: str) -> Column:
    """_sub by a pattern that runs to a closing mark."""
    first = pattern.split(r"\{")[0].replace("\\\\", "\\")
    head, tail = _cut_last(c, closer)
    return F.when(F.contains(c, F.lit(first)), F.concat(_sub(head, pattern, by), tail)).otherwise(c)


def cut_between(c: Column, opener: str, closer: str) -> Column:
    """Without what stands from an opening mark to the next closing one, in capitals or not; an open one stays."""

    def cut(part):
        closed = F.endswith(F.lower(part), F.lit(closer)) & F.contains(F.lower(part), F.lit(opener))
        return F.when(closed, F.get(F.split(part, rf"(?i)\Q{opener}\E", 2), F.lit(0))).otherwise(part)

    parts = F.split(c, rf"(?i)(?<=\Q{closer}\E)")
    return F.when(F.contains(F.lower(c), F.lit(opener)) & F.contains(F.lower(c), F.lit(closer)), F.array_join(F.transform(parts, cut), "")).otherwise(c)


def count_of(c: Column, piece: str) -> Column:
    """Occurrences of a literal piece that don't overlap."""
    some = ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece.encode())).cast("int")
    return F.when(F.contains(c, F.lit(piece)), some).when(c.isNotNull(), 0)


def _unescaped(c: Column, piece: str) -> Column:
    """Occurrences of a piece without a backslash before it."""
    return count_of(c, piece) - count_of(c, "\\" + piece)


def count_re(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def any_of(c: Column, pieces) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in pieces))


def normalize(c: Column) -> Column:
    """TXT1: runs of white space become one space, none at the ends."""
    return F.trim(_sub(c, _SPACE, " "))


def tokenize(c: Column, limit: int = MAX_TOKENS) -> Column:
    """TXT2: markup tokens, the first limit of them."""
    return F.slice(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), 1, limit)


def body_or_all(c: Column) -> Column:
    """TXT15: what stands between begin and end of the document; the whole text where they don't."""
    return let(c, lambda c: F.coalesce(_body(c), c))


def _body(c: Column) -> Column:
    """The document's body; null where it doesn't begin and end."""
    return let(behind(c, BEGIN), lambda b: F.when(F.contains(b, F.lit(END)), F.substring_index(b, END, 1)))


def canonical(c: Column) -> Column:
    """TXT3: rewrites in order that drop differences of style, and at last all white space."""
    c = body_or_all(c)
    for pattern, by in (*CANONICAL, (_SPACE, "")):
        c = _sub(c, pattern, by)
    return c


def strip_reasoning(c: Column) -> Column:
    """TXT4: without closed think blocks; behind the last tag that stays open."""
    open_ = lambda c: F.when(F.contains(F.lower(c), F.lit(THINK)), F.element_at(F.split(c, r"(?i)<think>"), -1)).otherwise(c)
    return let(cut_between(c, THINK, THINK_END), open_)


def clean_response(c: Column) -> Column:
    """TXT5: the document of a model's answer, from its class to its last end."""
    def unfenced(c):
        inner = let(behind(c, FENCE), lambda b: F.when(F.contains(b, F.lit(FENCE)), strip(_sub(F.substring_index(b, FENCE, 1), FENCE_LABEL, ""))))
        return F.coalesce(inner, F.when(F.startswith(c, F.lit(FENCE)), _no_lone_fence(c)), c)

    def document(c):
        start = F.instr(c, "\\documentclass")
        last = F.length(c) - F.length(F.substring_index(c, END, -1))
        return F.when(start == 0, c).when(F.contains(c, F.lit(END)), F.substring(c, start, F.greatest(last + 1 - start, F.lit(0)))).otherwise(F.substring(c, start, F.length(c)))

    return strip(let(let(strip(strip_reasoning(F.coalesce(c, F.lit("")))), unfenced), document))


def _no_lone_fence(c: Column) -> Column:
    return strip(_sub(_sub(c, r"\A```[a-zA-Z]*\n?", ""), r"\n?```\z", ""))


def clean_response_v1(c: Column) -> Column:
    """TXT6: without a fence at the begin and one at the end."""
    c = strip(c)
    c = _sub(c, r"\A```(?:latex|tex)?", "")
    return strip(_sub(c, r"```\z", ""))


def last_line(body: Column) -> Column:
    line = rstrip(body)
    for end in _ENDS_OF_LINES:
        line = F.substring_index(line, end, -1)
    return strip(line)


def odd_dollars(c: Column) -> Column:
    return _unescaped(c, "$") % 2 != 0


def _unequal_brackets(c: Column, variant: int) -> Column:
    count = count_of if variant == 1 else _unescaped
    return count(c, r"\[") != count(c, r"\]")


def _unequal_environments(c: Column) -> Column:
    return count_of(c, r"\begin{") != count_of(c, r"\end{")


def looks_truncated(c: Column, variant: int = 2) -> Column:
    """TXT7 (variant 1) and TXT8 (2): a text that breaks off. They differ on line breaks with spacing."""
    return let(body_or_all(c), lambda body: (rstrip(body) == "") | F.regexp_like(last_line(body), F.lit(DANGLING)) | odd_dollars(body) | _unequal_brackets(body, variant) | _unequal_environments(body))


def truncation_reason(c: Column) -> Column:
    """TXT9: why; compile_fail where the text doesn't look truncated."""
    body = body_or_all(c)
    return F.when(~looks_truncated(c, 1), "compile_fail").when(odd_dollars(body), "unbalanced_dollars").when(_unequal_brackets(body, 1), "unbalanced_brackets").when(_unequal_environments(body), "unbalanced_envs").when(F.regexp_like(last_line(body), F.lit(r"\\\\\s*$")), "ends_with_double_backslash").otherwise("dangling_operator")


def auto_fix(c: Column) -> Column:
    """TXT10: safe repairs: fences, markers, commands without a package, missing packages, class and ends."""
    c = let(strip(c), lambda c: F.when(F.startswith(c, F.lit("```")), _no_lone_fence(c)).otherwise(c))
    c = strip(F.replace(c, F.lit(REVIEWED), F.lit("")))
    c = let(c, lambda c: _sub_closed(c, r"\\require\{[^}]*\}", "", "}"))
    c = let(c, lambda c: _sub_closed(c, r"\\textcircled\{([^}]*)\}", "($1)", "}"))
    c = let(c, lambda c: F.when((F.octet_length(c) > F.length(c)) & F.regexp_like(c, F.lit("[\u2212\u2460-\u2473]")), _plain_signs(c)).otherwise(c))
    c = let(c, lambda c: F.when(F.contains(c, F.lit("\\documentclass")), c).otherwise(F.concat(F.lit("\\documentclass{article}\n"), c)))
    return let(let(let(c, _with_packages), _with_begin), lambda c: F.when(F.contains(c, F.lit("\\end{document}")), c).otherwise(F.concat(rstrip(c), F.lit("\n\n\\end{document}\n"))))


def _plain_signs(c: Column) -> Column:
    for i in range(20):
        c = F.replace(c, F.lit(chr(0x2460 + i)), F.lit(f"({i + 1})"))
    return F.replace(c, F.lit("\u2212"), F.lit("-"))


def _with_packages(c: Column) -> Column:
    """The packages that are needed and not named alone in the preamble go behind the line of the class."""

    def missing(preamble):
        needed = [F.when(~F.contains(preamble, F.lit(f"{{{p}}}")), F.lit(f"\\usepackage{{{p}}}")) for p in REQUIRED_PACKAGES]
        needed += [F.when(any_of(c, triggers) & ~F.contains(preamble, F.lit(f"{{{p}}}")), F.lit(f"\\usepackage{{{p}}}")) for p, triggers in TRIGGERED_PACKAGES.items()]
        return F.concat_ws("\n", *needed)

    def inserted(lines, names):
        """names behind the line that holds the first class."""
        before = F.instr(lines, F.lit("\\documentclass")) - 1
        line = F.substring_index(F.substring(lines, before + 1, F.length(lines)), "\n", 1)
        head = before + F.length(line)
        return F.concat(F.substring(lines, F.lit(1), head), F.lit("\n"), names, F.substring(lines, head + 1, F.length(lines)))

    return let(let(F.substring_index(c, BEGIN, 1), missing), lambda m: F.when(m == "", c).otherwise(let(_one_kind_of_lines(c), lambda x: inserted(x, m))))


def _one_kind_of_lines(c: Column) -> Column:
    """A text with plain line feeds between its lines, none at its end."""
    plain = F.when(any_of(c, _ENDS_OF_LINES[1:]), _sub(c, _LINES, "\n")).otherwise(c)
    return let(plain, lambda c: F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))


def _with_begin(c: Column) -> Column:
    """The begin of the document goes behind the last package, or to the end."""
    used = F.regexp_extract(_cut_last(c, "}")[0], r"(?s)\A(.*\\usepackage(?:\[[^\]]*\])?\{[^}]*\})", 1)
    begun = let(used, lambda u: F.when(u != "", F.concat(u, F.lit("\n\n\\begin{document}\n"), F.substring(c, F.length(u) + 1, F.length(c)))).otherwise(F.concat(c, F.lit("\n\\begin{document}\n"))))
    return F.when(F.contains(c, F.lit("\\begin{document}")), c).otherwise(begun)


def strip_tokens(c: Column) -> Column:
    """TXT14: without region tags, special tokens and image placeholders."""
    return _sub(_sub(cut_between(c, REGION, REGION_END), SPECIAL, ""), PLACEHOLDER, "")


def drop_furniture(c: Column) -> Column:
    """TXT13: without the lines that are printed page furniture."""
    lines = F.split(_sub(c, rf"(?:{_LINES})\z", ""), _LINES)

    def furniture(x):
        """Few lines hold a word of the pattern; those beyond ASCII may hold one in other letters."""
        likely = any_of(F.lower(x), ("space", "rough", "mention", "of", "q")) | (F.octet_length(x) > F.length(x))
        return likely & F.regexp_like(strip(x), F.lit(FURNITURE))

    return F.array_join(F.filter(lines, lambda x: ~furniture(x)), "\n")


def _no_headings(c: Column) -> Column:
    return _sub(c, HEADING, "")


def to_document(c: Column) -> Column:
    """TXT11: the text regions of tagged output as a document."""
    return let(strip(F.coalesce(c, F.lit(""))), _regions_document)


def _regions_document(raw: Column) -> Column:
    kinds = F.transform(F.regexp_extract_all(raw, F.lit(DET), F.lit(1)), F.lower)
    contents = F.slice(F.split(raw, DET), 2, 1 << 30)
    kept = F.filter(F.arrays_zip(kinds.alias("k"), contents.alias("c")), lambda z: ~z["k"].isin(*DROPPED_REGIONS))
    chunks = F.filter(F.transform(kept, lambda z: strip(drop_furniture(strip_tokens(z["c"])))), lambda t: t != "")
    body = F.when(F.regexp_like(raw, F.lit(DET)), F.array_join(chunks, "\n\n")).otherwise(drop_furniture(strip_tokens(raw)))
    return F.concat(F.lit(PREAMBLE), strip(_sub(_no_headings(body), r"\n{3,}", "\n\n")), F.lit(POSTAMBLE))


def finish_document(c: Column) -> Column:
    """TXT12: a complete document as it is, else wrapped."""
    raw = strip(F.coalesce(c, F.lit("")))
    raw = strip(_sub(cut_between(raw, REGION, REGION_END), SPECIAL, ""))

    def wrapped(raw):
        whole = F.contains(raw, F.lit("\\documentclass")) & F.contains(raw, F.lit("\\end{document}"))
        return F.when(whole, raw).otherwise(F.concat(F.lit(PREAMBLE), strip(_no_headings(raw)), F.lit(POSTAMBLE)))

    return let(raw, wrapped)


def has_body(c: Column) -> Column:
    return _body(c).isNotNull()


def has_math(c: Column) -> Column:
    """TXT16: math in the document's body; null where there is no body."""
    return let(_body(c), lambda b: F.when(b.isNotNull(), _inline_math(b) | F.when(F.contains(b, F.lit("\\begin{")), F.coalesce(let(_cut_last(b, "}")[0], _has_environment), F.lit(False))).otherwise(False)))


def _inline_math(c: Column) -> Column:
    return any_of(c, ("$", "\\[")) & F.regexp_like(c, F.lit(INLINE_MATH))


def _has_environment(c: Column) -> Column:
    """Whether an environment's begin has an end somewhere behind it; c ends with a closing brace."""
    return F.regexp_like(F.get(F.split(c, ENV_BEGIN, 2), F.lit(1)), F.lit(ENV_END))


def has_illegible(c: Column) -> Column:
    """TXT17"""

    def on_line(line):
        tests = (F.contains(behind(behind(line, opener), "illegible"), F.lit(closer)) for opener, closer in ILLEGIBLE)
        return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))

    lines = F.split(F.lower(c), "[\n\r\x85\u2028\u2029]")
    return F.contains(F.lower(c), F.lit("illegible")) & F.exists(lines, on_line)


def yes_no(c: Column) -> Column:
    """TXT18: the first YES or NO of an answer, else ?."""
    found = F.regexp_extract(F.upper(strip_reasoning(c)), r"\b(YES|NO)\b", 1)
    return let(found, lambda v: F.when(v == "", "?").otherwise(v))


def first_log_error(c: Column) -> Column:
    """TXT19"""
    found = F.regexp_extract(c, r"(?m)^!.*", 0)
    return F.when(found == "", "Unknown error").otherwise(strip(found))


def model_label(path: Column) -> Column:
    """TXT20: the last name of a path, of its parent where it is final."""
    names = F.split(_sub(path, r"[/\\]+\z", ""), r"[/\\]")
    last = F.element_at(names, -1)
    return F.when((last == "final") & (F.size(names) > 1), F.try_element_at(names, F.lit(-2))).otherwise(last)


def safe_label(c: Column) -> Column:
    return _sub(c, r"[^A-Za-z0-9._-]", "_")


def content_hash(c: Column, digits: int = 32) -> Column:
    """TXT21"""
    return F.substring(F.md5(F.encode(c, "UTF-8")), 1, digits)


def plain_panel(c: Column, width: int = 2000) -> Column:
    """TXT22"""
    return F.substring(F.translate(F.replace(c, F.lit("$"), F.lit("")), "_^", "  "), 1, width)


def assistant_text(conversations: Column) -> Column:
    """TXT23: the first text of the assistant, empty where there is none."""
    return F.coalesce(F.try_element_at(F.filter(conversations, lambda m: m["role"].isin("assistant", "gpt")), F.lit(1))["content"], F.lit(""))


def error_class(message: Column) -> Column:
    """TXT24: the first class that fits, in order."""
    m, out = F.lower(message), F.lit("retry")
    for kind, pieces in reversed(ERROR_CLASSES):
        out = F.when(any_of(m, pieces), kind).otherwise(out)
    return out


def error_class_of(message: str) -> str:
    """TXT24 of one message, for a connector's own use."""
    return next((kind for kind, pieces in ERROR_CLASSES if any(p in message.lower() for p in pieces)), "retry")


def http_retryable(code: Column) -> Column:
    """TXT25"""
    return code.isin(429, 500, 502, 503, 504)


def messages(system: str, user: Column) -> Column:
    """TXT26: a request of a system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def image_url(content: Column, path: Column) -> Column:
    """SRC17: the bytes of an image as a data URL; Spark breaks base64 into lines, which go."""
    kind = F.when(F.lower(path).rlike(r"\.jpe?g$"), "jpeg").when(F.lower(path).rlike(r"\.webp$"), "webp").otherwise("png")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), _sub(F.base64(content), r"[\r\n]", ""))
