"""Text functions: redaction, truncation, tokens, entities, intents, hashed embeddings."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
#: What counts as a secret, in the order of replacement.
SECRETS = (
    r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|$)",
    r"(?<![A-Za-z0-9])sk-(?:proj-)?[A-Za-z0-9_-]{16,}",
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,})",
    r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{10,}",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",
    r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{30,60}",
    r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{20,}",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9_-])",
    r"(?i)(?<![A-Za-z0-9])Bearer\s+[A-Za-z0-9._~+/-]{8,}=*",
    r"(?i)(?<![A-Za-z0-9])(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|rediss|amqp|amqps|mssql|ftp|ftps|https?|smtp|ssh)://[^\s\"'<>]+@[^\s\"'<>]+",
    r"(?i)(?<![A-Za-z0-9])(?:api[\s_-]?key|secret|token|password|authorization|auth|bearer|credential|private[\s_-]?key|access[\s_-]?key|refresh[\s_-]?token|access[\s_-]?token|id[\s_-]?token|session[\s_-]?token|client[\s_-]?secret|database[\s_-]?url|connection[\s_-]?string|x[\s_-]?api[\s_-]?key)(?![A-Za-z0-9])[\"']?[ \t]*[:=][ \t]*(?:(?:bearer|basic|token)\s+)?(?:\"[^\"]*\"|'[^']*'|[^\s\"',;}]+)",
    r"(?<![A-Za-z0-9])thm_[A-Za-z0-9_\-.]{1,200}_[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9])thm_[A-Za-z0-9_-]{44,}",
)
_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with word boundaries that hold for ASCII words only, whatever the Java version."""
    return pattern.replace(r"\b", _BOUNDARY)


#: Negations (a list joined for one search), opposites and stop words.
NEGATION = r"(?i)\bnot\b|\bnever\b|\bno longer\b|\bstop\b|\bavoid\b|\bdon'?t\b|\binstead\b|\bbut\b|\bhowever\b|ไม่|ห้าม|เลิก|อย่า"
ANTONYMS = "tabs spaces vim emacs light dark mysql postgres windows mac linux react vue ios android ชา กาแฟ แมว สุนัข กลางคืน กลางวัน ร้อน เย็น หวาน เค็ม เปิด ปิด ซ้าย ขวา บน ล่าง ก่อน หลัง ไทย อังกฤษ".split()
STOPWORDS = (
    "the a an is are to of and or in on for with this that it i you me my we be was were been am do does did have has had not no but so if then than as at by from into about can could will would should shall may might must just very there here what when where which who how why all any some such own same too its our your they them their he she his her him us s t "
    "และ หรือ ที่ ให้ ของ การ ไม่ ใน มี ผม ฉัน คือ ไป มา แล้ว ด้วย อะไร ทำ ใส่ เป็น อยู่ จาก กับ ว่า นี้ นั้น โดย ครับ ค่ะ ต้อง ยัง เพื่อ แบบ หน่อย นะ ล่ะ เลย ก็ แต่ ถ้า ช่วย"
).split()
#: Intents, as pattern and the type of what is remembered.
INTENTS = (
    (r"(?i)(?:remember|จำไว้ว่า|บันทึกว่า)\s+(?:that\s+)?(.+)", "FACT"),
    (r"(?i)(?:i prefer|my preference is|ผมชอบ|ฉันชอบ|เราชอบ)\s+(.+)", "PREFERENCE"),
    (r"(?i)(?:i use|เราใช้|ฉันใช้)\s+([^\s,]+)\s+(?:for|ในการ|เพื่อ)\s+(.+)", "PREFERENCE"),
    (r"(?i)(?:don'?t use|ห้ามใช้|อย่าใช้)\s+([^,]+)(?:,\s*(?:use|ใช้)\s+(.+))?", "LESSON"),
    (r"(?i)(?:instead|use)\s+(.+?)\s+(?:rather than|แทน)\s+(.+)", "LESSON"),
)
#: English and Thai counterparts.
SYNONYMS = (
    ("deploy", "ดีพลอย"), ("server", "เซิร์ฟเวอร์"), ("database", "ฐานข้อมูล"), ("repository", "รีโพสิทอรี"), ("repository", "รีโพ"),
    ("install", "ติดตั้ง"), ("package", "แพ็กเกจ"), ("project", "โปรเจกต์"), ("version", "เวอร์ชัน"), ("test", "เทสต์"),
    ("node", "โหนด"), ("backup", "สำรอง"), ("error", "ข้อผิดพลาด"), ("search", "ค้นหา"), ("save", "บันทึก"),
    ("delete", "ลบ"), ("memory", "ความจำ"), ("memory", "หน่วยความจำ"), ("config", "คอนฟิก"), ("debug", "ดีบั๊ก"),
)
DIMENSIONS = 512


def truncate(text: Column, most: Column | int) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(most <= 0, "").when(F.length(text) > most, F.concat(F.substring(text, F.lit(1), most - 1), F.lit("…"))).otherwise(text)


def _suspect(text: Column) -> Column:
    """A cheap test that every text with a secret passes."""
    low = F.lower(text)

    def any_of(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    marks = ("private key", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "akia", "aiza", "npm_", "eyj", "bearer", "thm_")
    named = any_of(":", "=") & any_of("key", "secret", "token", "password", "auth", "credential", "database", "connection")
    return any_of(*marks) | named | (low.contains("://") & low.contains("@"))


def redact(text: Column) -> Column:
    out = text
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, REDACTED)
    return F.when(_suspect(text), out).otherwise(text)


@F.pandas_udf(T.StringType())
def redact_json(values):
    """Redact keys and values of a JSON document; ten levels down everything is redacted."""
    import re

    import pandas as pd

    patterns = [re.compile(p) for p in SECRETS]

    def text(x: str) -> str:
        for p in patterns:
            x = p.sub(REDACTED, x)
        return x

    def walk(x, depth: int):
        if depth >= 10 and isinstance(x, dict | list):
            return REDACTED
        if isinstance(x, dict):
            return {text(k): walk(v, depth + 1) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, depth + 1) for v in x]
        return text(x) if isinstance(x, str) else x

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(walk(json.loads(x), 0), ensure_ascii=False)
        except ValueError:
            return text(x)

    return pd.Series([one(x) for x in values])


@F.pandas_udf(T.StringType())
def nfkc(values):
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(text: Column, compatibility: bool = True) -> Column:
    """Lower case, NFKC, one space for white space, letters, digits and spaces only. Only texts beyond ASCII go to Python."""
    text = F.lower(text)
    text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if compatibility else text
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[^\p{L}\p{N}\s]", ""))


def has_thai(text: Column) -> Column:
    return text.rlike("[฀-๿]")


def loose(text: Column) -> Column:
    """Lower case without tone marks and the like."""
    return F.regexp_replace(F.lower(text), "[่-ํ]", "")


def ascii_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def index_terms(text: Column) -> Column:
    """The lexical index's terms: runs of letters, digits, private use and marks, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{Co}\p{M}]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9ก-์]+"), F.lit(0)))


def keywords(text: Column) -> Column:
    """Words of two characters or more that are neither numbers nor stop words."""
    stop = F.split(F.lit(" ".join(STOPWORDS)), " ")
    words = F.transform(F.split(text, r"\s+"), lambda w: F.trim(F.lower(w)))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w))


#: What names an entity, in order: quotations, joined capitalised words, names, compounds, files, links, words.
ENTITIES = (
    "\"[^\"]{2,60}\"|'[^']{2,60}'",
    r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+",
    r"\b[A-Z][a-z]{2,}\b",
    r"\b[a-z]+(?:-[a-z]+){1,}\b",
    r"(?i)\b[\w./-]+\.(?:ts|js|mjs|py|json|md|yaml|yml)\b",
    r"(?i)\bhttps?://\S+",
    r"\b[A-Za-z][A-Za-z0-9_-]*\b",
)


def entities(text: Column, most: int = 12) -> Column:
    """Quoted strings, identifiers, names, compounds, files, links and longer words; the first distinct ones."""
    stop = F.split(F.lit(" ".join(STOPWORDS)), " ")

    def every(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(ascii_edges(pattern)), F.lit(group))

    quoted = F.transform(every(ENTITIES[0]), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    words = F.filter(every(ENTITIES[-1]), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, F.lower(w)))
    found = F.concat(quoted, *[every(p) for p in ENTITIES[1:-1]], words)
    found = F.transform(found, lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2)), 1, most)


def intent(text: Column) -> tuple[Column, Column]:
    """(type, what) of the first intent that matches with three characters or more."""
    kind, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name in reversed(INTENTS):
        got = F.trim(F.regexp_extract(text, pattern, 1))
        hit = text.rlike(pattern) & (F.length(got) >= 3)
        kind, what = F.when(hit, name).otherwise(kind), F.when(hit, got).otherwise(what)
    return kind, what


def first_intent(text: Column) -> tuple[Column, Column]:
    """(type, what) by the first pattern that matches, however short what it takes is."""
    kind, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name in reversed(INTENTS):
        hit = text.rlike(pattern)
        kind, what = F.when(hit, name).otherwise(kind), F.when(hit, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(what)
    return kind, what


def negated(text: Column) -> Column:
    return text.rlike(ascii_edges(NEGATION))


def antonyms(text: Column) -> Column:
    """The opposites that a text names, also inside words."""
    low = F.lower(text)
    return F.filter(F.split(F.lit(" ".join(ANTONYMS)), " "), lambda w: low.contains(w))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<(/?memory-reference\b[^>]*>)", "&lt;$1")


def synonyms(term: Column) -> Column:
    """The lower-case term and its counterparts in the other language."""
    table: dict[str, list[str]] = {}
    for a, b in SYNONYMS:
        table.setdefault(a, []).append(b)
        table.setdefault(b, []).append(a)
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(F.array(F.lower(term)), F.coalesce(F.try_element_at(known, F.lower(term)), F.array().cast("array<string>"))))


def fnv_bucket(token: Column) -> Column:
    """32-bit FNV-1a modulo 512, folded in nine bits, which is exact because 512 divides 2**32."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(453), lambda h, c: (h.bitwiseXOR(c.bitwiseAND(511)) * 403).bitwiseAND(511))


def grams(text: Column) -> Column:
    """Words and marked character trigrams of the text without white space."""
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    n = F.length(bare)
    three = F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(F.concat(F.lit("g:"), bare))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.lit("g:"), F.substring(bare, i, F.lit(3)))))
    return F.concat(ascii_words(text), three)


def hash_prefix(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 8)


def verify_token(token: Column, stored: Column) -> Column:
    return F.coalesce(F.sha2(token, 256) == stored, F.lit(False))


#: What the command-line hook takes for a secret, in order.
HOOK_SECRETS = (
    r"(?i)(api[_-]?key|secret|token|password|auth|bearer|credential|private[_-]?key|access[_-]?key|database[_-]?url|connection[_-]?string)\s*[=:]\s*\S+",
    r"(?i)(sk-[a-zA-Z0-9]{20,})",
    r"(?i)(ghp_[a-zA-Z0-9]{36})",
    r"(?i)(glpat-[a-zA-Z0-9\-]{20,})",
    r"(?i)(Bearer\s+[a-zA-Z0-9\-_]+)",
    r"(?i)(-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----)",
)


def hook_redact(text: Column) -> Column:
    """In each line the first match of the first pattern that matches."""

    def line(x: Column) -> Column:
        out = x
        for pattern in reversed(HOOK_SECRETS):
            once = F.regexp_replace(x, f"(?s)^(.*?){pattern}", f"$1{REDACTED.replace('[', chr(92) + '[')}")
            out = F.when(x.rlike(pattern), once).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def error_status(response: Column) -> Column:
    """error where a tool's answer says so: is_error is true, or "error" within its first 200 characters."""
    hit = response.rlike(r'(?i)"is_error"\s*:\s*true') | F.lower(F.substring(response, 1, 200)).contains("error")
    return F.when(F.coalesce(hit, F.lit(False)), "error").otherwise("success")
