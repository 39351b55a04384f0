"""Structure of one markdown text: front matter, headings, links. Plain Python, one pass per document."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from urllib.parse import unquote_to_bytes

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_ATTRIBUTES = re.compile(r"[ \t]*\{[^{}]*\}$")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")


def split_front_matter(text: str) -> tuple[str | None, int]:
    """The block between a leading --- line and a closing --- or ... line, and where the body begins."""
    if not re.match(r"---\r?\n", text):
        return None, 0
    begin = at = text.index("\n") + 1
    while at < len(text):
        end = text.find("\n", at)
        line = text[at : len(text) if end < 0 else end].rstrip("\r")
        if line in ("---", "..."):
            return text[begin:at], len(text) if end < 0 else end + 1
        if end < 0:
            break
        at = end + 1
    return None, 0


# --- front matter -------------------------------------------------------------------------------


# A quoted text opens at a scalar's start only; a doubled quote or an escape doesn't end it, and one never closed runs on.
_QUOTED = r"""(?:^|(?<=[\s\[{,:]))(?:"(?:[^"\\]|\\.)*(?:"|$)|'(?:[^']|'')*(?:'|$))"""
_NOTE = re.compile(_QUOTED + r"|(?P<note>(?<=[ \t])#.*)", re.DOTALL)
_MARK = re.compile(_QUOTED + r"|(?P<mark>[\[\]{},])", re.DOTALL)


def _uncommented(value: str) -> str:
    """A value without its comment."""
    notes = (m.start("note") for m in _NOTE.finditer(value) if m["note"])
    return value[: next(notes, len(value))].rstrip()


def _members(body: str) -> list[str]:
    """The parts of a flow list's body that commas of its own part; empty ones are none."""
    level, begin, found = 0, 0, []
    for m in _MARK.finditer(body):
        level += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m["mark"], 0)
        if m["mark"] == "," and level == 0:
            found.append(body[begin : m.start()].strip())
            begin = m.end()
    return [x for x in (*found, body[begin:].strip()) if x]


def _scalar(v: str):
    v = v.strip()
    if len(v) > 1 and v[0] == v[-1] == '"':
        try:
            return json.loads(v)
        except ValueError:
            return v[1:-1]
    if len(v) > 1 and v[0] == v[-1] == "'":
        return v[1:-1].replace("''", "'")
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in _members(v[1:-1])]
    if v in ("", "~", "null"):
        return None
    if v in ("true", "false"):
        return v == "true"
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", v):
        return float(v)
    return v


def _pair(line: str) -> tuple[str, str] | None:
    m = re.match(r"""("[^"]*"|'[^']*'|[^\s:#\[\]{}][^:]*?)\s*:(?:\s+(.*))?$""", line)
    return (str(_scalar(m[1])) if m[1][0] in "\"'" else m[1], m[2] or "") if m else None


def parse_yaml(block: str):
    """The value of a front-matter block: maps, lists, flow lists, quoted texts, numbers, booleans, null."""
    rows = [(len(x) - len(x.lstrip(" ")), _uncommented(x.strip("\r"))) for x in block.split("\n") if x.strip() and not x.strip().startswith("#")]

    def take(i: int, indent: int):
        if i < len(rows) and rows[i][1].lstrip().startswith("- ") or i < len(rows) and rows[i][1].strip() == "-":
            out = []
            while i < len(rows) and rows[i][0] == indent and (rows[i][1].lstrip().startswith("- ") or rows[i][1].strip() == "-"):
                item = rows[i][1].lstrip()[1:].strip()
                if (pair := _pair(item)) and not item.startswith(("[", '"', "'")):
                    inner = indent + len(rows[i][1].lstrip()) - len(item)
                    rows[i] = (inner, " " * inner + item)
                    value, i = take(i, inner)
                    out.append(value)
                    continue
                out.append(_scalar(item))
                i += 1
            return out, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            pair = _pair(rows[i][1].strip())
            i += 1
            if not pair:
                continue
            key, value = pair
            if value:
                found[key] = _scalar(value)
            elif i < len(rows) and (rows[i][0] > indent or rows[i][0] == indent and rows[i][1].lstrip().startswith("- ")):
                found[key], i = take(i, rows[i][0])
            else:
                found[key] = None
        while i < len(rows) and rows[i][0] > indent:
            i += 1
        return found, i

    return take(0, rows[0][0])[0] if rows else {}


def flatten(value) -> list[tuple[str, str | None, float | None, int]]:
    """(key, text, number, ord) of every scalar of a front matter: dotted keys, a row per list element."""
    out: list = []
    left = [((), value, 0)] if isinstance(value, dict) else []
    while left:
        keys, v, place = left.pop()
        if isinstance(v, dict):
            left += [((*keys, str(k)), x, place) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            left += [(keys, v[i], i) for i in reversed(range(len(v)))]
        else:
            number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
            out.append((".".join(keys), v if v is None or isinstance(v, str) else json.dumps(v), number, place))
    return out


# --- headings -----------------------------------------------------------------------------------


def _plain(heading: str) -> str:
    """A heading's text without inline marks."""
    s = re.sub(r"!?\[\[([^\]|]*\|)?([^\]]*)\]\]", r"\2", heading)
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"(`+)(.+?)\1", r"\2", s)
    s = re.sub(r"(\*\*|__|~~|\*)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s).strip()


def _code_lines(lines: list[str], first: int) -> list[bool]:
    """Whether each line is part of a fenced or indented code block."""
    out, fence, blank = [], None, True
    for i, line in enumerate(lines):
        if i < first:
            out.append(False)
            continue
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence, blank = None, True
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(True)
        else:
            code = line.startswith(("    ", "\t")) and line.strip() != "" and blank
            out.append(code)
            blank = not line.strip() or code
    return out


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line from 1, level, text) of ATX and setext headings outside code."""
    _, body = split_front_matter(text)
    first = text.count("\n", 0, body)
    lines = [x.rstrip("\r") for x in text.split("\n")]
    code, out, para = _code_lines(lines, first), [], None
    for i, line in enumerate(lines[first:], first):
        if code[i]:
            para = None
        elif m := _ATX.match(line):
            title = re.sub(r"(^|[ \t]+)#+$", "", m[2] or "")
            out.append((i + 1, len(m[1]), _plain(_ATTRIBUTES.sub("", title))))
            para = None
        elif para is not None and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", line)):
            out.append((para + 1, 1 if m[1][0] == "=" else 2, _plain(_ATTRIBUTES.sub("", " ".join(x.strip() for x in lines[para:i])))))
            para = None
        elif not line.strip() or re.match(r"^ {0,3}(>|[-*+] |\d+[.)] |\|)", line) or re.match(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$", line):
            para = None
        elif para is None:
            para = i
    return out


def sections(text: str) -> list[dict]:
    """Sections of the headings: path, span in lines, words of its own and in all."""
    found = headings(text)
    lines = text.split("\n")
    last = len(lines) - 1 if text.endswith("\n") else len(lines)
    words = [0]
    for line in lines:
        words.append(words[-1] + len(line.encode().split()))
    out, stack = [], []
    for i, (line, level, title) in enumerate(found):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        end = next((x[0] - 1 for x in found[i + 1 :] if x[1] <= level), last)
        own = found[i + 1][0] - 1 if i + 1 < len(found) else last
        out.append({"heading_path": " / ".join(t for _, t in stack), "heading": title, "level": level, "line_from": line, "line_to": end, "nwords": words[own] - words[line - 1], "nwords_total": words[end] - words[line - 1]})
    return out


# --- links --------------------------------------------------------------------------------------


def percent_decoded(s: str) -> str:
    try:
        return unquote_to_bytes(s).decode()
    except UnicodeDecodeError:
        return s


def links(text: str) -> list[dict]:
    """Links in order: kind (wiki, embed, md, image), target, anchor, alias, external, line, and the target's place (or -1)."""
    if "[" not in text and "<" not in text:
        return []
    _, body = split_front_matter(text)
    lines = text.split("\n")
    code = _code_lines([x.rstrip("\r") for x in lines], text.count("\n", 0, body))
    plain = "\n".join("\0" * len(line) if block else line for line, block in zip(lines, code, strict=True))
    plain = plain[:body] + re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: re.sub(r"[^\n]", "\0", m[0]), plain[body:], flags=re.S)
    out = []
    for m in re.finditer(r"\[\[([^\n]*?)\]\]", plain):
        inner = text[m.start(1) : m.end(1)]
        if not inner:
            continue
        before, _, alias = inner.partition("|")
        before = before.removesuffix("\\")
        raw, _, anchor = before.partition("#")
        target, embed = raw.strip(), text[m.start() - 1 : m.start()] == "!"
        out.append({"kind": "embed" if embed else "wiki", "target": target, "anchor": anchor.strip() or None, "alias": alias.strip() or None, "external": bool(_SCHEME.match(target)) or "@" in target and "/" not in target, "offset": m.start() - embed, "at": m.start(1) + len(raw) - len(raw.lstrip())})
    for m in _INLINE.finditer(plain, body):
        dest = m[3] if m[3] is not None else m[4]
        if not dest:
            continue
        cut = re.search(r"[#?]|$", dest).start()
        target, anchor = percent_decoded(dest[:cut]), percent_decoded(dest[cut:].partition("#")[2]) or None
        external = dest.startswith("?") or bool(_SCHEME.match(dest)) or "@" in dest and "/" not in dest or target.isascii() and target.isdigit()
        out.append({"kind": "image" if m[1] else "md", "target": target, "anchor": anchor, "alias": m[2].strip() or None, "external": external, "offset": m.start(), "at": m.start(3) if m[3] is not None else m.start(4)})
    for m in _AUTO.finditer(plain, body):
        out.append({"kind": "md", "target": m[1].partition("#")[0], "anchor": m[1].partition("#")[2] or None, "alias": None, "external": True, "offset": m.start(), "at": -1})
    out.sort(key=lambda x: x["offset"])
    breaks = [m.start() for m in re.finditer("\n", text)] if out else []
    return [{"line": bisect_left(breaks, x["offset"]) + 1, **x} for x in out]


def title_of(front: object, found: list[tuple[int, int, str]]) -> str | None:
    """Front matter's title, else the first heading of level 1."""
    if isinstance(front, dict) and front.get("title") is not None:
        title = front["title"]
        title = (title if isinstance(title, str) else json.dumps(title)).strip()
        if title:
            return title
    return next((t for _, level, t in found if level == 1), None)


# --- edits --------------------------------------------------------------------------------------


def _rendered(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_rendered, value)) + "]"
    if isinstance(value, str):
        return value if value and _scalar(value) == value and not re.search(r"[:#\[\]{},\"'\n]|^[-?&*!|>%@`\s]|\s$", value) else json.dumps(value, ensure_ascii=False)
    return json.dumps(value)


def set_property(text: str, key: str, value, remove: bool = False) -> str:
    """text with a top-level property set, or removed; only that key's lines change.

    A new key goes before the closing fence, and a text without front matter gets one. Line ends and a byte order mark stay.
    """
    mark, body = ("\ufeff", text[1:]) if text.startswith("\ufeff") else ("", text)
    end = "\r\n" if "\r\n" in body.split("\n", 1)[0] + "\n" else "\n"
    block, _ = split_front_matter(body)
    line = f"{key}: {_rendered(value)}{end}"
    if block is None:
        return text if remove else f"{mark}---{end}{line}---{end}{body}"
    begin = body.index("\n") + 1
    rows = block.splitlines(keepends=True)
    at = next((i for i, row in enumerate(rows) if (p := _pair(row.strip())) and p[0] == key and row[:1] not in " \t"), None)
    if at is None:
        new = block if remove else block + line
    else:
        stop = at + 1
        while stop < len(rows) and (rows[stop][:1] in " \t" and rows[stop].strip() or rows[stop].startswith("- ")):
            stop += 1
        new = "".join([*rows[:at], *([] if remove else [line]), *rows[stop:]])
    return mark + body[:begin] + new + body[begin + len(block) :]


def relative(folder: str, target: str) -> str:
    """An absolute path as seen from a folder."""
    import posixpath

    return posixpath.relpath(target, folder)


def retargeted(text: str, moves: dict[int, str], path: str) -> str:
    """text, a document at path, with the targets of links (by their place) turned to files that moved; each keeps its style.

    Markdown links stay relative (a leading ./ or / and a missing .md are kept), wiki links name the file, or its path if they had one.
    """
    folder = path.rsplit("/", 1)[0] or "/"
    for x in sorted((x for x in links(text) if x["at"] in moves), key=lambda x: -x["at"]):
        new, old = moves[x["at"]], x["target"]
        if x["kind"] in ("wiki", "embed"):
            out = new.lstrip("/") if "/" in old else new.rsplit("/", 1)[1]
        else:
            out = new if old.startswith("/") else ("./" if old.startswith("./") else "") + relative(folder, new)
        if not old.lower().endswith(".md"):
            out = re.sub(r"\.md$", "", out)
        if x["kind"] in ("md", "image"):
            out, old = out.replace(" ", "%20"), text[x["at"] :][: len(re.match(r"[^#?)\s>]*", text[x["at"] :])[0])]
        text = text[: x["at"]] + out + text[x["at"] + len(old) :]
    return text
