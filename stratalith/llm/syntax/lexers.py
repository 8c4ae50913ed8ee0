"""Token streams: (class, offset, newline before it) of a text, per language.

Reserved and contextual words and all punctuation are classes of their own; other names are NAME,
numbers NUM, texts STR. What no rule matches is ERR; a comment or text that never closes is CUT.
"""

from __future__ import annotations

import re

# Reserved words (and words with a meaning in some place) of each language.
WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield await async of get set from as target meta",
    "typescript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield await async of get set from as target meta type declare namespace module abstract readonly is keyof infer asserts satisfies override unique global accessor out",
    "rust": "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await default union macro_rules box raw _",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits non yield module open requires exports opens uses provides to with transitive",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ __asm__ __extension__ __inline __restrict asm",
    "json": "true false null",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}

# Punctuation of each language, longest first where one starts another.
PUNCT = {
    "python": "**= //= >>= <<= ... := -> ** // >> << <= >= == != += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =",
    "javascript": "**= <<= >>>= >>= &&= ||= ??= === !== ... => ** ++ -- << >>> >> <= >= == != && || ?? += -= *= /= %= &= |= ^= ?. + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; = ? @",
    "typescript": "**= <<= &&= ||= ??= === !== ... => ** ++ -- << <= >= == != && || ?? += -= *= /= %= &= |= ^= ?. + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; = ? @",
    "rust": "<<= ..= ... :: -> => .. << <= >= == != && || += -= *= /= %= ^= &= |= + - * / % ^ ! & | < > = @ . , ; : # $ ? ( ) [ ] { } ~",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~",
    "java": "<<= ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << + - * / % & | ^ ! ~ < > = ? : ( ) [ ] { } , ; . @",
    "c": "<<= >>= ... -> ++ -- << >> <= >= == != && || *= /= %= += -= &= ^= |= ## + - * / % & | ^ ! ~ < > = ? : ( ) [ ] { } , ; . #",
    "json": "{ } [ ] , :",
}


def _words(text: str) -> str:
    return "|".join(re.escape(p) for p in sorted(text.split(), key=len, reverse=True))


_INT = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*"
_DEC = r"[0-9](?:_?[0-9])*"
_FLOAT = rf"(?:{_DEC})?\.{_DEC}(?:[eE][+-]?{_DEC})?|{_DEC}\.?(?:[eE][+-]?{_DEC})|{_DEC}\."
_ESC1 = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_ESC2 = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'
_BLOCK = r"/\*[\s\S]*?\*/"

_PY_PRE = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_SPEC = {
    "python": [
        ("STR", rf"{_PY_PRE}(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\")"),
        ("CUT", rf"{_PY_PRE}(?:'''|\"\"\")"),
        ("STR", rf"{_PY_PRE}(?:{_ESC1}|{_ESC2})"),
        ("NUM", rf"(?:{_INT}|(?:{_FLOAT})[jJ]?|{_DEC}[jJ]?)(?![\w])"),
        ("NAME", r"[^\W\d]\w*"),
        ("P", _words(PUNCT["python"])),
    ],
    "json": [
        ("STR", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'),
        ("NUM", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])"),
        ("NAME", r"[A-Za-z_]\w*"),
        ("P", _words(PUNCT["json"])),
    ],
    "rust": [
        ("STR", r'(?:b|c)?r(#*)"[\s\S]*?"\1'),
        ("STR", r'(?:b|c)?"(?:[^"\\]|\\[\s\S])*"'),
        ("CUT", r'(?:b|c)?(?:r#*)?"'),
        ("STR", r"b?'(?:[^'\\\n\r\t]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'"),
        ("LIFE", r"'[^\W\d]\w*"),
        ("NUM", rf"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:\.(?![._\w]))?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?![\w])"),
        ("NAME", r"(?:r#)?[^\W\d]\w*"),
        ("P", _words(PUNCT["rust"])),
    ],
    "go": [
        ("STR", r"`[^`]*`"),
        ("CUT", r"`"),
        ("STR", r'"(?:[^"\\\n]|\\.)*"'),
        ("STR", r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"),
        ("NUM", rf"(?:{_INT}|0[0-7_]*|{_FLOAT}|{_DEC})i?(?![\w])"),
        ("NAME", r"[^\W\d]\w*"),
        ("P", _words(PUNCT["go"])),
    ],
    "java": [
        ("STR", r'"""[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?"""'),
        ("CUT", r'"""'),
        ("STR", r'"(?:[^"\\\n\r]|\\.)*"'),
        ("STR", r"'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"),
        ("NUM", rf"(?:(?:{_INT})[lL]?|(?:{_FLOAT})[fFdD]?|{_DEC}[lLfFdD]?)(?![\w])"),
        ("NAME", r"(?:[^\W\d]|\$)[\w$]*"),
        ("P", _words(PUNCT["java"])),
    ],
    "c": [
        ("STR", r'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'),
        ("CHR", r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[\s\S])+'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[uUlLfF]*(?![\w])"),
        ("NAME", r"[^\W\d]\w*"),
        ("P", _words(PUNCT["c"])),
    ],
    "javascript": [
        ("STR", rf"{_ESC1}|{_ESC2}"),
        ("NUM", rf"(?:(?:{_INT})n?|{_FLOAT}|(?:0|[1-9](?:_?[0-9])*)n?)(?![\w$])"),
        ("PRIV", r"#(?:[^\W\d]|\$)[\w$]*"),
        ("NAME", r"(?:[^\W\d]|\$)[\w$]*"),
        ("P", _words(PUNCT["javascript"])),
    ],
}
_SPEC["typescript"] = [*_SPEC["javascript"][:-1], ("P", _words(PUNCT["typescript"]))]


def _compile(spec) -> tuple[re.Pattern, list[str]]:
    groups, names = [], [""]
    for cls, pattern in spec:
        index = len(names)
        pattern = pattern.replace(r"\1", rf"\{index + 1}")
        groups.append(f"({pattern})")
        names += [cls] * re.compile(groups[-1]).groups
    return re.compile("|".join(groups)), names


_COMPILED = {lang: _compile(spec) for lang, spec in _SPEC.items()}
_SPACE = re.compile(r"[ \t\f\v\u00a0\ufeff]+")
_LINE = re.compile(r"\r\n|\n|\r|\u2028|\u2029")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[A-Za-z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
# After these a slash divides.
_ENDS_VALUE = frozenset(["NAME", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", "PRIV", ")", "]", "this", "super", "null", "true", "false", "of", "get", "set", "from", "as", "async", "type", "++", "--"])
# A Go line that ends in one of these ends a statement.
_GO_ENDS = frozenset(["NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_C_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line include_next import ident".split())
_RUST_COMMENT = re.compile(r"/\*|\*/")


def _skip_rust_comment(text: str, i: int) -> int:
    depth = 0
    for m in _RUST_COMMENT.finditer(text, i):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def tokens(text: str, lang: str):
    """Yield (class, offset, first on its line)."""
    if lang == "python":
        yield from _python(text)
        return
    pattern, names = _COMPILED[lang]
    words = WORDS[lang]
    i, n, newline, prev = 0, len(text), True, ""
    js = lang in ("javascript", "typescript")
    slashes = lang != "json"
    braces: list[str] = []
    conds = 0
    if js and text.startswith("#!") or lang == "rust" and text.startswith("#!/"):
        m = _LINE.search(text)
        i = m.start() if m else n
    if lang != "json" and text.startswith("\ufeff"):
        i = 1
    while i < n:
        ch = text[i]
        if ch in " \t\f\v\u00a0\ufeff":
            if lang == "json" and ch not in " \t":
                yield "ERR", i, newline
                return
            i = _SPACE.match(text, i).end() if lang != "json" else i + 1
            continue
        m = _LINE.match(text, i) if ch in "\r\n\u2028\u2029" else None
        if m:
            if lang == "go" and prev in _GO_ENDS:
                yield ";", i, False
                prev = ";"
            newline, i = True, m.end()
            continue
        if slashes and ch == "/" and i + 1 < n and text[i + 1] in "/*":
            if text[i + 1] == "/":
                m = _LINE.search(text, i)
                i = m.start() if m else n
                continue
            if lang == "rust":
                j = _skip_rust_comment(text, i)
            else:
                j = text.find("*/", i + 2)
                j = j + 2 if j >= 0 else -1
            if j < 0:
                yield "CUT", i, newline
                return
            if _LINE.search(text, i, j):
                if lang == "go" and prev in _GO_ENDS:
                    yield ";", i, False
                    prev = ";"
                newline = True
            i = j
            continue
        if lang == "c" and ch == "#" and newline:
            m = re.compile(r"#[ \t]*([A-Za-z_]\w*)?").match(text, i)
            word = m.group(1)
            if word is not None and word not in _C_DIRECTIVES:
                yield "ERR", i, True
                return
            conds += 1 if word in ("if", "ifdef", "ifndef") else -1 if word == "endif" else 0
            if conds < 0:
                yield "ERR", i, True
                return
            j = i
            while True:  # a backslash continues the line; a block comment may span lines
                m = re.compile(r"\\\r?\n|/\*|\n|\r(?!\n)").search(text, j)
                if not m:
                    i = n
                    break
                if m.group() == "/*":
                    k = text.find("*/", m.end())
                    if k < 0:
                        yield "CUT", m.start(), True
                        return
                    j = k + 2
                elif m.group()[0] == "\\":
                    j = m.end()
                else:
                    i = m.start()
                    break
            continue
        if js:
            if ch == "/" and prev not in _ENDS_VALUE:
                m = _REGEX.match(text, i)
                if m:
                    yield "REGEX", i, newline
                    prev, newline, i = "REGEX", False, m.end()
                    continue
            if ch == "`" or ch == "}" and braces and braces[-1] == "`":
                first = ch == "`"
                m = _TPL.match(text, i + 1)
                j = m.end()
                if j >= n:
                    yield "CUT", i, newline
                    return
                if text[j] == "`":
                    cls = "TPL" if first else "TPLTAIL"
                    if not first:
                        braces.pop()
                    j += 1
                else:
                    cls = "TPLHEAD" if first else "TPLMID"
                    if first:
                        braces.append("`")
                    j += 2
                yield cls, i, newline
                prev, newline, i = cls, False, j
                continue
            if ch == "{":
                braces.append("{")
            elif ch == "}" and braces:
                braces.pop()
        m = pattern.match(text, i)
        if not m:
            yield "ERR", i, newline
            return
        cls = names[m.lastindex]
        if cls == "STR" and m.lastindex and names[m.lastindex] == "STR":
            pass
        if cls == "NAME":
            v = m.group()
            if v in words:
                cls = v
        elif cls == "P":
            cls = m.group()
        elif cls == "CUT":
            yield "CUT", i, newline
            return
        yield cls, i, newline
        prev, newline, i = cls, False, m.end()
    if lang == "go" and prev in _GO_ENDS:
        yield ";", n, False
    if lang == "c" and conds:
        yield "CUT", n, True


_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_FORMAT = re.compile(r"([fF][rR]?|[rR][fF])(\'\'\'|\"\"\"|\'|\")")
_PY_BRACE = re.compile(r"\\N\{[^{}\n]*\}|\\(?:\r\n|[^{}])|\{\{|\}\}|[{}]|\'\'\'|\"\"\"|[\'\"\r\n]")
_PY_RAW_BRACE = re.compile(r"\\[\'\"\\\r\n]|\{\{|\}\}|[{}]|\'\'\'|\"\"\"|[\'\"\r\n]")
_PY_CONVERT = re.compile(r"![rsa](?!\w)")
_PY_SHOWN = re.compile(r"=(?=\s*(?:[}:]|![rsa]))")


class _Field:
    """What is open in a format text: its text ("L"), a field's expression ("E") at some bracket
    depth, or the field's format ("S")."""

    __slots__ = ("mode", "quote", "raw", "depth")

    def __init__(self, mode: str, quote: str, raw: bool, depth: int):
        self.mode, self.quote, self.raw, self.depth = mode, quote, raw, depth


def _format_text(text: str, i: int, top: _Field) -> tuple[str, int]:
    """(class, end) of the next mark in the text or format part of a format text."""
    pattern = _PY_RAW_BRACE if top.raw else _PY_BRACE
    while True:
        m = pattern.search(text, i)
        if not m:
            return "CUT", i
        v, i = m.group(), m.end()
        if v == top.quote or top.mode == "S" and len(top.quote) == 1 and v[:1] == top.quote:
            return "FEND" if top.mode == "L" else "ERR", i
        if v[0] in "'\"" and len(v) == 3:
            i = m.start() + 1  # a shorter quote than three, or three of the other sort
            if top.quote == v[0]:
                return "FEND" if top.mode == "L" else "ERR", i
        elif v in "\r\n" and len(top.quote) == 1:
            return "ERR", m.start()
        elif v == "{" or v == "{{" and top.mode == "S":
            return "F{", m.start() + 1
        elif v == "}" or v == "}}" and top.mode == "S":
            return ("F}" if top.mode == "S" else "ERR"), m.start() + 1


def _python(text: str):
    pattern, names = _COMPILED["python"]
    words = WORDS["python"]
    i, n = (1 if text.startswith("\ufeff") else 0), len(text)
    stack, depth, opened = [(0, 0)], 0, []
    fields: list[_Field] = []
    at_start = True
    close = {")": "(", "]": "[", "}": "{"}
    while i < n:
        top = fields[-1] if fields else None
        if top and top.mode != "E":
            cls, j = _format_text(text, i, top)
            yield cls, i, False
            if cls in ("CUT", "ERR"):
                return
            i = j
            if cls == "FEND":
                fields.pop()
            elif cls == "F{":
                depth += 1
                opened.append("F")
                fields.append(_Field("E", top.quote, top.raw, depth))
            else:  # the end of a format ends its field
                del fields[-2:]
                depth -= 1
                opened.pop()
            continue
        if at_start and not depth:
            m = _PY_INDENT.match(text, i)
            j = m.end()
            if j < n and text[j] not in "#\r\n":
                if text[j] == "\\" and re.match(r"\\\r?\n", text[j:j + 3]):
                    pass
                col = alt = 0
                for c in m.group():
                    col, alt = ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0) if c == "\f" else (col + 1, alt + 1)
                if col > stack[-1][0]:
                    if alt <= stack[-1][1]:
                        yield "ERR", i, True
                        return
                    stack.append((col, alt))
                    yield "INDENT", i, True
                else:
                    while col < stack[-1][0]:
                        stack.pop()
                        yield "DEDENT", i, True
                    if col != stack[-1][0] or alt != stack[-1][1]:
                        yield "ERR", i, True
                        return
                at_start = False
            i = j
            if i >= n:
                break
        ch = text[i]
        if ch in " \t\f":
            i += 1
            continue
        if ch == "#":
            m = _LINE.search(text, i)
            i = m.start() if m else n
            continue
        if ch in "\r\n":
            if not depth and not at_start:
                yield "NEWLINE", i, False
                at_start = True
            i += 2 if text.startswith("\r\n", i) else 1
            continue
        if ch == "\\":
            m = re.compile(r"\\(?:\r\n|\n|\r)").match(text, i)
            if not m:
                yield "ERR", i, False
                return
            i = m.end()
            if i >= n:
                yield "CUT", i, False
                return
            continue
        if top and depth == top.depth and ch in "}:!=":
            if ch == "}":
                yield "F}", i, False
                fields.pop()
                depth -= 1
                opened.pop()
                i += 1
                continue
            if ch == ":":
                yield "F:", i, False
                fields.append(_Field("S", top.quote, top.raw, depth))
                i += 1
                continue
            m = _PY_CONVERT.match(text, i) if ch == "!" else _PY_SHOWN.match(text, i)
            if m:
                yield "F" + ch, i, False
                i = m.end()
                continue
        m = _PY_FORMAT.match(text, i) if ch in "fFrR" else None
        if m:
            yield "FSTART", i, False
            fields.append(_Field("L", m.group(2), "r" in m.group(1).lower(), depth))
            i = m.end()
            continue
        m = pattern.match(text, i)
        if not m:
            yield "ERR", i, False
            return
        cls = names[m.lastindex]
        if cls == "NAME":
            v = m.group()
            if v in words:
                cls = v
        elif cls == "P":
            cls = m.group()
            if cls in "([{":
                depth += 1
                opened.append(cls)
            elif cls in close:
                if opened and opened[-1] == close[cls]:
                    opened.pop()
                    depth -= 1
        elif cls == "CUT":
            yield "CUT", i, False
            return
        yield cls, i, False
        i = m.end()
    if fields and fields[-1].mode != "E":
        yield "CUT", n, False
        return
    if depth:
        return  # the brackets still open make the end state refuse the text
    if not at_start:
        yield "NEWLINE", n, False
    for _ in stack[1:]:
        yield "DEDENT", n, True
