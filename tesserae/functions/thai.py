"""Thai segmentation, synonyms and index text, all in built-in functions.

Segmentation is by the longest known word, else by a character with the vowels and marks after it;
regular expressions try alternatives in order, so words stand in order of length.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import SYNONYMS

#: Words that the segmenter knows, of software and of commands. More are a parameter (`extra`).
WORDS = (
    "ระบบ เซิร์ฟเวอร์ ฐานข้อมูล ข้อมูล ความจำ หน่วยความจำ โปรแกรม แอปพลิเคชัน แอป ไฟล์ โฟลเดอร์ โค้ด "
    "ฟังก์ชัน คลาส เมธอด ตัวแปร โมดูล มอดูล สตริง อาร์เรย์ แพ็กเกจ แพ็กเก็ต ไลบรารี รันไทม์ "
    "เวอร์ชัน สคริปต์ เอพีไอ เอ็นจิน คีย์ ค่า โทเคน ตาราง คอลัมน์ แถว ดัชนี สคีมา "
    "เคียวรี ควิวรี ทรานแซกชัน เครือข่าย อินเทอร์เน็ต เบราว์เซอร์ เว็บไซต์ รหัสผ่าน ผู้ใช้ บัญชี อีเมล ล็อก "
    "ล็อกอิน ดีบั๊ก บั๊ก บัค โอเพนซอร์ส เดสก์ท็อป โมบาย คลาวด์ โปรเซส เธรด พาร์เซอร์ คอมไพเลอร์ "
    "ลิงก์ แมป เครื่องมือ ภาษา พร้อม รองรับ "
    "ติดตั้ง ถอนการติดตั้ง ติดตัง เปิดใช้งาน ปิดใช้งาน อัปเดต อัปเกรด ดาวน์เกรด ดาวน์โหลด อัปโหลด "
    "กู้คืน สำรอง บันทึก ลบ แก้ไข สร้าง เขียน อ่าน ค้นหา กรอง เรียง จัดเรียง "
    "เชื่อมต่อ แยก รวม เพิ่ม ลด คูณ หาร บวก ส่ง รับ เปิด ปิด "
    "หยุด พัก ต่อ ข้าม ยกเลิก กด คลิก พิมพ์ ใส่ แทรก คัดลอก วาง "
    "ย้าย เปลี่ยน แปลง แปล รัน เทสต์ ทดสอบ เรียก เรียกใช้ แสดง ซ่อน ตรวจ "
    "ตรวจสอบ ตั้งค่า กำหนด อนุญาต ปฏิเสธ เริ่ม เริ่มต้น คืนค่า รีเซ็ต เรียนรู้ จำ ทำงาน "
    "พยายาม ลอง ต้องการ อยากได้ เข้าใจ ตอบ ถาม ช่วย ดีพลอย"
).split()
CLUSTER = "[฀-๿][฀ฯ-๿]*"
TONES = "่้๊๋์ํ"
TOKEN = r"[\p{L}\p{N}\p{Co}\p{M}]+"
_EDGE = "\u0001"


def word_pattern(extra: tuple[str, ...] = ()) -> str:
    known = sorted({*WORDS, *extra}, key=lambda w: (-len(w), w))
    return f"({'|'.join(map(re.escape, known))}|{CLUSTER})"


def _accents() -> tuple[str, str]:
    """Small Latin letters with one mark, and the letters without it."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii():
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
_FOLD = str.maketrans(ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case without Latin accents, as the lexical index compares."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[̀-ͯ]", "")


def folded(x: str) -> str:
    return re.sub("[̀-ͯ]", "", x.lower().translate(_FOLD))


def terms(text: Column) -> Column:
    """The index's terms in order: runs of letters, digits, private use and marks."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def term_list(x: str) -> list[str]:
    kinds = "".join("x" if (k := unicodedata.category(c))[0] in "LNM" or k == "Co" else " " for c in folded(x))
    return [folded(x)[m.start() : m.end()] for m in re.finditer("x+", kinds)]


def has_thai(text: Column) -> Column:
    return text.rlike("[฀-๿]")


def loose(text: Column) -> Column:
    """Lower case without tone marks."""
    return F.translate(F.lower(text), TONES, "")


def loosened(x: str) -> str:
    return x.lower().translate(dict.fromkeys(map(ord, TONES)))


def _merge_pattern(term: str) -> str:
    between = f"(?:{_EDGE}{_EDGE})?"
    return _EDGE + between.join(map(re.escape, term)) + _EDGE


def _merges(forced: dict[str, str]) -> list[tuple[str, str]]:
    return [(_merge_pattern(t), f"{_EDGE}{f}{_EDGE}") for t, f in sorted(forced.items(), key=lambda x: -len(x[0]))]


def segmented(text: Column, extra: tuple[str, ...] = (), forced: dict[str, str] | None = None) -> Column:
    """Thai runs with spaces around their words; other text as it is. Again changes nothing.

    `forced` are terms that stay one word, replaced by their value where whole words of a run make them up.
    """
    out = F.regexp_replace(text, word_pattern(extra), f"{_EDGE}$1{_EDGE}")
    for pattern, value in _merges(forced or {}):
        out = F.regexp_replace(out, pattern, value)
    return F.when(has_thai(text), F.regexp_replace(F.regexp_replace(out, _EDGE, " "), " {2,}", " ")).otherwise(text)


def segments(x: str, extra: tuple[str, ...] = (), forced: dict[str, str] | None = None) -> list[str]:
    """The words of a query's chunk, as `segmented` pads them."""
    out = re.sub(word_pattern(extra), rf"{_EDGE}\1{_EDGE}", x)
    for pattern, value in _merges(forced or {}):
        out = re.sub(pattern, value, out)
    return out.replace(_EDGE, " ").split()


def word_tokens(text: Column, extra: tuple[str, ...] = (), forced: dict[str, str] | None = None) -> Column:
    """Words of letters a-z and digits, and Thai words, in lower case."""
    return F.regexp_extract_all(F.lower(segmented(text, extra, forced)), F.lit("[a-z0-9]+|[฀-๿]+"), F.lit(0))


def counterparts(extra: tuple[tuple[str, str], ...] = ()) -> dict[str, list[str]]:
    """The terms of both languages with what they stand for in the other."""
    table: dict[str, list[str]] = {}
    for a, b in [(x.lower(), y.lower()) for x, y in (*SYNONYMS, *extra)]:
        for x, y in ((a, b), (b, a)):
            if y not in table.setdefault(x, []):
                table[x].append(y)
    return table


def _let(value: Column, body) -> Column:
    """Evaluate `value` once for every use in `body`."""
    return F.transform(F.array(value), body)[0]


def expanded(padded: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """Segmented text with the counterparts of its known words that it lacks, for the index.

    A word counts if it is a whole token, or, in Thai, whole tokens in a row make it up. Texts that
    hold no known word anywhere, which is most, are told by plain searches and left as they are.
    """
    table = counterparts(extra)

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def added(text: Column, low: Column, thai: Column, spaced: Column) -> Column:
        found = []
        for term, others in table.items():
            there = spaced.contains(f" {term} ") if term.isascii() else thai & low.rlike(r"(?<!\S)" + r"\s*".join(map(re.escape, term)) + r"(?!\S)")
            for other in others:
                shown = " ".join(segments(other))
                found.append(F.when(there & ~low.contains(shown), shown))
        more = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), " ")
        return _let(more, lambda m: F.rtrim(F.concat_ws(" ", text, F.when(F.length(m) > 0, m))))

    def of(text: Column, low: Column, thai: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.regexp_replace(low, r"\s+", " "), F.lit(" "))
        some = thai | any_of([low.contains(t) for t in table if t.isascii()])
        return F.when(some, _let(spaced, lambda s: added(text, low, thai, s))).otherwise(text)

    return _let(padded, lambda t: _let(F.lower(t), lambda low: _let(has_thai(low), lambda th: of(t, low, th))))


def query_phrases(query: str, fuzzy: bool = False, extra: tuple[tuple[str, str], ...] = ()) -> list[list[str]]:
    """The phrases of a query's first eight chunks, any of which may match: ordered terms, and counterparts of known ASCII chunks."""
    table, out = counterparts(extra), []
    for chunk in query.split()[:8]:
        chunk = loosened(chunk) if fuzzy else chunk
        thai = bool(re.search("[฀-๿]", chunk))
        for form in [chunk] if thai else [chunk, *table.get(chunk.lower(), [])]:
            form = loosened(form) if fuzzy else form
            phrase = [t for w in (segments(form) if re.search("[฀-๿]", form) else [form]) for t in term_list(w)]
            if phrase and phrase not in out:
                out.append(phrase)
    return out


def phrase_column(query: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """`query_phrases` as a Column, for many queries at once: array<array<string>>."""
    table = {k: [term_list(" ".join(segments(v))) for v in vs] for k, vs in counterparts(extra).items() if k.isascii()}
    other = F.create_map(*[x for k, vs in table.items() for x in (F.lit(k), F.array(*[F.array(*map(F.lit, v)) for v in vs]))])
    chunks = F.slice(F.filter(F.split(query, r"\s+"), lambda c: c != ""), 1, 8)
    own = F.transform(chunks, lambda c: terms(F.when(has_thai(c), segmented(c)).otherwise(c)))
    more = F.flatten(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(other, F.lower(c)), F.array().cast("array<array<string>>"))))
    return F.array_distinct(F.filter(F.concat(own, more), lambda p: F.size(p) > 0))
