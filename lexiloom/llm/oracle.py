"""SQL with the same results as the pN_ queries, in DuckDB's dialect, where SQL can express them.

All of it is brute force over whole tables: every pair that shares a word, every
window of 120 characters.  Nothing is imported from the operators.
"""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
# Letters of other scripts that pass for Latin ones, and what they pass for.
_ALIKE = "АВЕІЈКМНОРСТУХЅҮԌԚԜаеіјорсухѕԁԛԝһӏүкмтвнΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹικρυαϳͿγτχηε"
_LATIN = "ABEIJKMHOPCTYXSYGQWaeijopcyxsdqwhlykmtbhABEZHIKMNOPTYXovcCikpuajJytxne"
_UNSEEN = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{2800}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff0}-\x{fffb}\x{e0000}-\x{e0fff}\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{84}\x{86}-\x{9f}]"
_SPACE = r"[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ACCENT = r"[\x{0300}-\x{036f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}]"
_EAST = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Hangul}\x{3001}-\x{3003}\x{3008}-\x{3011}]"


def _bare(x: str) -> str:
    """Without invisible characters, full-width letters and ligatures plain, composed."""
    flat = f"translate(regexp_replace({x}, '{_UNSEEN}', '', 'g'), '{_WIDE}', '{_PLAIN}')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        flat = f"replace({flat}, '{a}', '{b}')"
    return f"nfc_normalize({flat})"


def _canonical_words(x: str) -> str:
    """Words of the canonical text: letters of other scripts are replaced inside runs of letters that hold a Latin one."""
    runs = f"regexp_extract_all({_bare(x)}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    replaced = f"list_transform({runs}, lambda r: case when regexp_matches(r, '\\p{{Latin}}') then translate(r, '{_ALIKE}', '{_LATIN}') else r end)"
    return f"regexp_extract_all(lower(array_to_string({replaced}, '')), '[\\p{{L}}\\p{{N}}]+')"


_P1 = (
    f"with t as (select distinct cand_id, unnest([title, abstract]) as t from candidates), w as (select distinct cand_id, unnest({_canonical_words('t')}) as w from t where t is not null),"
    " n as (select cand_id, count(*) as n from w group by 1 having count(*) >= 75), k as (select w.* from w join n using (cand_id)),"
    " c as (select a.cand_id as cand_a, b.cand_id as cand_b, count(*) as c from k a join k b on a.w = b.w and a.cand_id < b.cand_id group by 1, 2)"
    " select cand_a, cand_b from c join n x on x.cand_id = cand_a join n y on y.cand_id = cand_b where c >= 0.7 * (x.n + y.n - c)"
)

_P4 = (
    "with f as (select distinct cand_id, unnest(['title', 'abstract']) as fld, unnest([title, abstract]) as t from candidates)"
    f" select distinct cand_id, fld from f where regexp_matches(t, '{_UNSEEN}') or regexp_matches(t, '{_SPACE}') or regexp_matches(t, '[{_WIDE}\\x{{fb00}}-\\x{{fb06}}]')"
    f" or (not regexp_matches(t, '{_EAST}') and regexp_matches(t, '[\\x{{ff01}}-\\x{{ff0f}}\\x{{ff1a}}-\\x{{ff20}}\\x{{ff3b}}-\\x{{ff40}}\\x{{ff5b}}-\\x{{ff5e}}\\x{{ffe0}}-\\x{{ffe6}}]'))"
    f" or regexp_matches(t, '\\p{{L}}{_ACCENT}') or len(list_filter(regexp_extract_all({_bare('t')}, '[\\p{{L}}\\p{{M}}]+'), lambda r: regexp_matches(r, '\\p{{Latin}}') and regexp_matches(r, '[{_ALIKE}]'))) > 0"
)

_RECORDS = (
    "rec as (select distinct 'abstract' as kind, cand_id as id, null::BIGINT as own, abstract as t from candidates where abstract is not null"
    " union select 'paragraph', seg_id, null, source_paragraph from segments where source_paragraph is not null union select 'snippet', seg_id, cand_id, candidate_snippet from segments where candidate_snippet is not null),"
    " wins as (select kind, id, own, t, i, substr(t, i, 120) as s from (select *, unnest(range(1, length(t) - 118)) as i from rec where length(t) >= 120))"
)
_P5 = (
    f"with {_RECORDS}, u as (select distinct kind, id, own, s from wins), a as (select * from u where kind = 'abstract')"
    " select distinct b.kind, a.id as id_a, b.id as id_b from a join u b using (s) where case b.kind when 'abstract' then a.id < b.id when 'snippet' then b.own is null or b.own <> a.id else true end"
)
_P5_SHARED = (
    f"with {_RECORDS}, held as (select s, min(kind || ':' || id) as first, max(kind || ':' || id) as last from wins group by 1),"
    " hit as (select kind, id, t, i from wins join held using (s) where first <> last or first <> kind || ':' || id),"
    " gaps as (select *, lead(i) over (partition by kind, id, t order by i) - i as ahead, i - lag(i) over (partition by kind, id, t order by i) as behind from hit),"
    " covered as (select kind, id, t, sum(least(120, coalesce(ahead, 120))) as shared_chars, count_if(behind is null or behind > 120) as n_spans from gaps group by 1, 2, 3)"
    " select r.kind, r.id, length(r.t)::INTEGER as n_chars, coalesce(shared_chars, 0)::BIGINT as shared_chars, coalesce(n_spans, 0)::BIGINT as n_spans from (select distinct kind, id, t from rec) r"
    " left join covered c on c.kind = r.kind and c.id = r.id and c.t = r.t"
)

_WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda s: len(regexp_extract_all(s, '\\p{L}+'))), lambda n: n > 0)"
_P8 = (
    f"with d as (select doc_id, lang, {_WORDS} as ws, {_SENTENCES} as sl from documents where text is not null), k as (select doc_id, lang, unnest(ws) as w from d), c as (select doc_id, lang, w, count(*) as n from k group by all),"
    " l as (select lang as own, w, sum(n) as n from c where lang is not null group by 1, 2), tot as (select own, sum(n) as total from l group by 1),"
    " sc as (select doc_id, l.own, sum(c.n * ln(l.n / total * 1e7 + 1)) as score from c join l on l.w = c.w join tot on tot.own = l.own group by 1, 2),"
    " own as (select distinct c.doc_id, coalesce(first_value(sc.own) over (partition by c.doc_id order by score desc nulls last, sc.own desc), c.lang, 'und') as own from c left join sc using (doc_id)),"
    " p as (select c.doc_id, own.own, w, n from c join own using (doc_id)), v as (select own, w, sum(n) as total from p group by 1, 2),"
    " r as (select own, w, count(*) over (partition by own order by total desc range between unbounded preceding and current row) as rank from v),"
    " q as (select doc_id, own, rank, sum(n) over (partition by doc_id order by rank rows unbounded preceding) as run, sum(n) over (partition by doc_id) as n from p join r using (own, w)),"
    " cov as (select doc_id, own, min(rank) filter (run >= 0.5 * n) as cover_50, min(rank) filter (run >= 0.7 * n) as cover_70, min(rank) filter (run >= 0.8 * n) as cover_80, min(rank) filter (run >= 0.9 * n) as cover_90 from q group by 1, 2)"
    " select doc_id, own, cover_50::BIGINT as cover_50, cover_70::BIGINT as cover_70, cover_80::BIGINT as cover_80, cover_90::BIGINT as cover_90, round(list_avg(sl), 6) as sentence_mean, list_max(sl)::INTEGER as sentence_max,"
    " round(list_avg(list_transform(ws, lambda w: length(w))), 6) as word_length from cov join d using (doc_id)"
)

SQL: dict[str, str] = {"p1_found": _P1, "p4_found": _P4, "p5_found": _P5, "p5_shared": _P5_SHARED, "p8_features": _P8}
