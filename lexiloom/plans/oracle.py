"""SQL with the same results, for an independent engine (DuckDB's dialect).

Written from the semantics, not from the plans: lists and lambdas stand where
the plans use joins or array expressions.
"""

from __future__ import annotations

from lexiloom.functions.grams import CHAR_GRAM, STOP_WORDS, WINDOW, WORD_GRAM
from lexiloom.functions.text import UNIMPORTANT
from lexiloom.operators.scoring import UNSHARED

_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_PLAIN = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x1c-\\x1f\\x0b\\p{{Z}}\\x{{0085}}]+|[\\s\\x1c-\\x1f\\x0b\\p{{Z}}\\x{{0085}}]+$', '', 'g')"


def _normal(x: str) -> str:
    """Lower case, decomposed, without marks and punctuation, single spaces."""
    flat = f"translate(lower(coalesce({x}, '')), '{_WIDE}', '{_PLAIN}')"
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("²", "2"), ("ϲ", "ς"), ("\u3000", " ")):
        flat = f"replace({flat}, '{a}', '{b}')"
    bare = f"regexp_replace(strip_accents({flat}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x{{0085}}]', '', 'g')"
    return f"trim(regexp_replace(lower({bare}), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _hash(x: str) -> str:
    return f"list_transform({x}, lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT)"


def _char_grams(n: str) -> str:
    return f"list_transform(range(1, length({n}) - {CHAR_GRAM} + 2), lambda i: substr({n}, i, {CHAR_GRAM}))"


def _word_grams(n: str) -> str:
    words = f"list_filter(string_split({n}, ' '), lambda w: w <> '')"
    return f"list_transform(range(1, len({words}) - {WORD_GRAM} + 2), lambda i: array_to_string(({words})[i:i+{WORD_GRAM - 1}], ' '))"


def _prints(name: str, source: str, key: str) -> str:
    """CTEs ending in ``name(key, fp)`` over ``source(key, t)``."""
    win = lambda h: f"case when len({h}) < {WINDOW} then {h} else list_transform(range(1, len({h}) - {WINDOW} + 2), lambda i: list_min({h}[i:i+{WINDOW - 1}])) end"
    return (
        f"{name}_n as (select {key}, {_normal('t')} as n from {source}),"
        f" {name}_h as (select {key}, {_hash(_char_grams('n'))} as ch, {_hash(_word_grams('n'))} as wh from {name}_n),"
        f" {name} as (select {key}, list_distinct(list_concat({win('ch')}, {win('wh')})) as fp from {name}_h)"
    )


_SRC = "src as (select doc_id as src_id, coalesce(title,'') || ' ' || coalesce(abstract,'') || ' ' || coalesce(body,'') as t from papers)"
_CAND = "cand as (select distinct cand_id, coalesce(abstract,'') as t from candidates)"
_PAIRS = "pairs as (select distinct src_id, cand_id from candidates)"


def _weights(name: str, source: str, key: str) -> str:
    """CTEs ending in ``name(key, gram, w)``."""
    return (
        f"{name}_w as (select {key}, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]+'),"
        f" lambda w: length(w) > 1 and w not in ({_quoted(STOP_WORDS)})) as ws from {source}),"
        f" {name}_g as (select {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]))) as gram from {name}_w),"
        f" {name} as (select {key}, gram, 1 + ln(count(*)) as w from {name}_g group by all)"
    )


_K = UNSHARED * UNSHARED
_COSINE = (
    f"{_SRC}, {_CAND}, {_PAIRS}, {_weights('sw', 'src', 'src_id')}, {_weights('cw', 'cand', 'cand_id')},"
    " sa as (select src_id, sum(w*w) as s_all from sw group by 1), ca as (select cand_id, sum(w*w) as c_all from cw group by 1),"
    " shared as (select p.src_id, p.cand_id, sum(s.w*c.w) as dot, sum(s.w*s.w) as ss, sum(c.w*c.w) as cc from pairs p join cw c using (cand_id)"
    " join sw s on s.src_id = p.src_id and s.gram = c.gram group by 1, 2),"
    f" cosines as (select src_id, cand_id, least(1.0, dot / sqrt((ss + {_K}*(s_all-ss)) * (cc + {_K}*(c_all-cc)))) as cosine"
    " from shared join sa using (src_id) join ca using (cand_id))"
)
_JACCARD = (
    f"{_prints('sp', 'src', 'src_id')}, {_prints('cp', 'cand', 'cand_id')},"
    " met as (select src_id, cand_id, len(list_intersect(s.fp, c.fp)) as common, len(s.fp) as ns, len(c.fp) as nc from pairs join sp s using (src_id) join cp c using (cand_id)),"
    " jac as (select src_id, cand_id, common::BIGINT as common, (case when ns > 0 and nc > 0 then ns + nc - common else 0 end)::BIGINT as united from met)"
)
_TENTHS = "(case when united > 0 then (2000*common + united) // (2*united) else 0 end)::BIGINT"
_KEY = "substr(lower(" + _strip("coalesce(title,'')") + "), 1, 80)"
_FIRST = f"firsts as (select * from (select *, row_number() over (partition by src_id, {_KEY} order by arrival_seq) as rn from candidates) where rn = 1)"
_MATCHED = "list_filter(coalesce(keywords, []), lambda k: contains(lower(coalesce(c.abstract,'')), lower(k)))"
_SHARE = f"(case when len(coalesce(keywords, [])) > 0 then (2000*len({_MATCHED}) + len(keywords)) // (2*len(keywords)) else 0 end)::BIGINT"
_TIER = "case when score >= 600 then 'high' when score >= 350 then 'medium' else 'low' end"
_MARK = "case risk_tier when 'high' then '🔴' when 'medium' then '🟡' else '🟢' end"
_REPORT = (
    f"{_COSINE}, {_JACCARD}, {_FIRST},"
    f" base as (select c.src_id, c.cand_id, c.arrival_seq, c.title, c.abstract, floor(coalesce(cosine,0)*1000 + 0.5)::BIGINT as tf, {_SHARE} as kw, coalesce({_TENTHS}, 0) as fp"
    " from firsts c join papers p on p.doc_id = c.src_id left join cosines k on k.src_id = c.src_id and k.cand_id = c.cand_id"
    " left join jac j on j.src_id = c.src_id and j.cand_id = c.cand_id),"
    " scored as (select *, ((45*tf + 20*kw + 35*fp + 50) // 100)::BIGINT as score from base),"
    f" rep as (select *, {_TIER} as risk_tier, row_number() over (partition by src_id order by score desc, arrival_seq) as rank from scored)"
)
_NAMES = "list_filter(string_split(regexp_replace(coalesce(authors,''), ' et al\\.$', ', Q. More'), ', '), lambda a: a <> '')"


def _et_al(names: str) -> str:
    return f"(array_to_string({names}[1:3], ', ') || case when len({names}) > 3 then ' et al.' else '' end)"


_VENUE = (
    "case when contains(lower(coalesce(url,'')), '10.1109') or contains(lower(coalesce(title,'')), 'ieee') then 'IEEE'"
    " when contains(lower(coalesce(url,'')), '10.1145') or contains(lower(coalesce(title,'')), 'acm') then 'ACM'"
    " when contains(lower(coalesce(url,'')), '10.1007') or contains(lower(coalesce(title,'')), 'springer') then 'Springer'"
    " when contains(lower(coalesce(url,'')), '10.1016') or contains(lower(coalesce(title,'')), 'elsevier') then 'Elsevier' else 'CrossRef' end"
)
_LABEL_ROWS = (
    "('risk_high','zh','高風險'), ('risk_high','en','High Risk'), ('risk_high','ja','高リスク'), ('risk_medium','zh','中風險'), ('risk_medium','en','Medium Risk'), ('risk_medium','ja','中リスク'),"
    " ('risk_low','zh','低風險'), ('risk_low','en','Low Risk'), ('risk_low','ja','低リスク')"
)
_SENT = (
    "sents as (select cand_id, t, list_filter(list_transform(string_split(regexp_replace(" + _strip("t") + ", '([。！？.!?])[\\s\\p{Z}]+', '\\1␞', 'g'), '␞'), lambda s: " + _strip("s")
    + "), lambda s: length(s) > 10) as ss from cand),"
    " wins as (select cand_id, case when len(ss) <= 3 then [t] else list_transform(range(1, len(ss) - 1), lambda i: array_to_string(ss[i:i+2], ' ')) end as ws from sents)"
)

# --- raw first pages: line breaks, headers and the parts between them, in RE2's dialect ---

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
_NOT_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
_S = r"[\s\x0b\x1c-\x1f\p{Z}\x{0085}]"
_HEAD_RE = (
    r"(?i)^(ieee\b|transactions\b|proceedings\s+of|acm\s+(transactions|sigchi|siggraph)|springer\b|elsevier\b|nature\b|vol\.?\s*\d|volume\s+\d|no\.?\s*\d"
    r"|this\s+(article|paper)\s+(was|is|has\s+been)\s+(published|accepted|submitted)|authorized\s+licensed|digital\s+object\s+identifier|doi\s*:|arxiv\s*:|©\s*\d{4}|copyright)"
)
_PLACE_RE = (
    r"(?i)(department\s+of|school\s+of|university\s+(of|at)?|institute\s+of|laboratory|research\s+(center|group|lab)|faculty\s+of|college\s+of"
    r"|national\s+\w+\s+(university|institute)|@[\w.\-]+\.[a-z]{2,}|received\s+\w+\s+\d{1,2}|revised\s+\w+\s+\d{1,2}|accepted\s+\w+\s+\d{1,2})"
)
_NAMES_RE = r"^[A-Z][a-z]+([- ][A-Z][a-z]+)*\d*(\s*(and|,)\s*[A-Z][a-z]+([- ][A-Z][a-z]+)*\d*)+\s*$"
_ABSTRACT_RE, _INLINE_RE = rf"^(abstract|摘要|summary|概要){_S}*[:\-]?{_S}*$", rf"^[^\n]{{0,40}}?\babstract\b{_S}*[—–\-:]{_S}*"
_KEYS_RE, _INTRO_RE = rf"^(keywords?|index terms?|關鍵字|關鍵詞){_S}*[:\-]?{_S}*", rf"^(1\.?{_S}+introduction|1\.?{_S}+介紹|1\.?{_S}+緒論|introduction){_S}*$"
_CLOSE_RE = rf"^(\d+\.?{_S}+)?(conclusion|related work|references|acknowledgment|bibliography|參考文獻|結論)"


def _authors_line(x: str) -> str:
    return f"(length({x}) <= 120 and regexp_matches({x}, '{_NAMES_RE}'))"


def _front(x: str) -> str:
    return f"(regexp_matches({x}, '{_HEAD_RE}') or regexp_matches({x}, '{_PLACE_RE}') or contains({x}, '@') or {_authors_line(x)})"


def _upto(x: str, pattern: str) -> str:
    """What precedes the first match, null without one."""
    return f"case when regexp_matches({x}, '(?im){pattern}') then regexp_extract({x}, '(?ims)\\A(.*?){pattern}', 1) end"


def _past(x: str, pattern: str) -> str:
    """What follows the first match, null without one."""
    return f"case when regexp_matches({x}, '(?im){pattern}') then substr({x}, length(regexp_extract({x}, '(?ims)\\A.*?{pattern}', 0)) + 1) end"


def _clean(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


_LINES = f"list_filter(list_transform(regexp_split_to_array(coalesce(raw_text,''), '{_BREAK}'), lambda x: {_strip('x')}), lambda x: x <> '')"
_STARTS = (
    f"ended as (select doc_id, coalesce(raw_text,'') as raw, regexp_extract_all(coalesce(raw_text,''), '{_NOT_BREAK}*(?:{_BREAK})|{_NOT_BREAK}+$')[1:40] as ls from papers),"
    f" marked as (select doc_id, raw, ls, list_transform(list_transform(ls, lambda x: {_strip('x')}), lambda b: b <> '' and ({_front('b')} or regexp_matches(b, '^[\\d\\s,;.\\-]+$'))) as front from ended),"
    " starts as (select doc_id, raw, coalesce(list_sum(list_transform(ls[1:coalesce(nullif(list_position(front, false), 0), len(ls) + 1) - 1], lambda x: length(x))), 0)::INTEGER as pos from marked)"
)
_TITLES = (
    f"titles as (select doc_id, ls, list_filter(ls[1:20], lambda x: length(x) >= 10 and not regexp_matches(x, '^[\\d\\s]+$') and not regexp_matches(x, '(?i)^(abstract|keywords?|摘要|關鍵字)')"
    f" and not {_front('x')}) as fit from (select doc_id, {_LINES} as ls from papers)), title_of as (select doc_id, coalesce(fit[1], ls[1], '') as title from titles)"
)
_IMPORTANT = (
    "w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(abstract,'')), '[\\p{L}\\p{M}\\p{Nd}_]+')) as w, "
    "generate_subscripts(regexp_extract_all(lower(coalesce(abstract,'')), '[\\p{L}\\p{M}\\p{Nd}_]+'), 1) as pos from papers),"
    f" f as (select doc_id, w, count(*) as n, min(pos) as p from w where regexp_full_match(w, '[a-z]{{4,}}') and w not in ({_quoted(UNIMPORTANT)}) group by 1, 2),"
    " r as (select *, row_number() over (partition by doc_id order by n desc, p) as k from f)"
)
# paragraphs: short ones are carried into the next, step by step
_PARAS = (
    "pieces as (select {key}, list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '([。！？.!?])\\n', '\\1' || chr(10) || chr(10), 'g'), '\\n{{2,}}'), lambda x: "
    + _strip("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '') as ps from {source}),"
    " carried as (select {key}, ps, 0 as i, '' as kept, null::VARCHAR as para, 0 as k from pieces union all"
    " select {key}, ps, i + 1, case when length(j) >= 40 then '' else j end, case when length(j) >= 40 then j end, k + (length(j) >= 40)::INTEGER"
    " from (select *, case when kept = '' then ps[i + 1] else kept || ' ' || ps[i + 1] end as j from carried where i < len(ps))),"
    " paras as (select {key}, k - 1 as pos, para from carried where para is not null)"
)
_SEGMENTS = (
    f"{_PAIRS}, {_SRC}, {_CAND}, {_PARAS.format(key='src_id', text='t', source='src')}, pt as (select src_id * 100000 + pos as pid, para as t from paras), {_prints('pp', 'pt', 'pid')},"
    f" {_SENT}, wt as (select cand_id * 100000 + unnest(range(0, len(ws))) as wid, unnest(ws) as t from wins), {_prints('wp', 'wt', 'wid')},"
    " pw as (select p.src_id, p.cand_id, a.pid, b.wid, len(list_intersect(a.fp, b.fp)) as common, len(a.fp) as na, len(b.fp) as nb"
    " from pairs p join pp a on a.pid // 100000 = p.src_id join wp b on b.wid // 100000 = p.cand_id),"
    " pj as (select *, na + nb - common as united from pw where common > 0),"
    " best as (select * from (select *, row_number() over (partition by src_id, cand_id, pid order by common / united desc, wid) as rn from pj) where rn = 1 and common / united >= 0.01),"
    " seg as (select b.src_id, b.cand_id, (pid % 100000)::INTEGER as paragraph_index, substr(x.t, 1, 300) as source_paragraph, substr(y.t, 1, 300) as candidate_snippet,"
    " ((2000 * common + united) // (2 * united))::BIGINT as overlap from best b join pt x using (pid) join wt y using (wid)),"
    " top5 as (select * exclude (rk) from (select *, row_number() over (partition by src_id, cand_id order by overlap desc, paragraph_index) as rk from seg) where rk <= 5)"
)
# laid-out first pages: a line every 60 points, a word every 36, a gap after the eighth
_WORDS = (
    "pl as (select doc_id, unnest(range(0, len(l))) as line, unnest(l) as t from (select doc_id, string_split(raw_text, chr(10)) as l from papers where raw_text is not null)),"
    " pk as (select doc_id, line, unnest(range(0, len(k))) as k, unnest(k) as text from (select doc_id, line, string_split(t, ' ') as k from pl)),"
    " words as (select doc_id, text, (k % 16) * 36.0::DOUBLE + case when k % 16 >= 8 then 24 else 0 end as x0, 20.0::DOUBLE + line * 60 + (k // 16) * 12 as top from pk where text <> ''),"
    " bands as (select 0 as band, 612.0::DOUBLE * 0.3::DOUBLE as x union all select band + 1, x + 612.0::DOUBLE * 0.02::DOUBLE / 2 from bands where x + 612.0::DOUBLE * 0.02::DOUBLE / 2 < 612.0::DOUBLE * 0.7::DOUBLE),"
    " body as (select * from words where top > 792 * 0.25),"
    " counted as (select d.doc_id, band, any_value(b.x) as x, count(w.x0) as n from (select distinct doc_id from body) d cross join bands b"
    " left join body w on w.doc_id = d.doc_id and w.x0 >= b.x and w.x0 < b.x + 612.0::DOUBLE * 0.02::DOUBLE group by 1, 2),"
    " splits as (select doc_id, case when max(n) > 0 and min(n) < 0.1 * max(n) then arg_min(x, n * 1000 + band) + 612.0::DOUBLE * 0.02::DOUBLE / 2 end as split_x from counted group by 1),"
    " sided as (select w.*, split_x, max(case when x0 < split_x and x0 + 30 > split_x + 6.12 then top + 10 end) over (partition by w.doc_id) as low from words w left join splits using (doc_id) where top >= 792 * 0.05),"
    " regions as (select *, case when split_x is null or top + 10 <= greatest(coalesce(low, 0), 792 * 0.05) then 0 when x0 >= split_x + 612 * 0.015 then 2 else 1 end as region from sided),"
    " ordered as (select doc_id, 1 as page, region, (round_even(top / 2, 0) * 2)::INTEGER as line, string_agg(text, ' ' order by x0, text) as text from regions group by all)"
)
_FONT = (
    "fl as (select doc_id, unnest(range(0, len(l))) as i, trim(unnest(l)) as t from (select doc_id, list_transform(string_split(raw_text, chr(10)), lambda x: regexp_replace(x, ' +', ' ', 'g')) as l from papers where raw_text is not null)),"
    " fs as (select doc_id, i, t, case when i = 0 then 18 else 10 end as size from fl where t <> ''),"
    " tries as (select s.doc_id, z as wanted, i, t, size >= 0.85 * z and length(t) > 2 as fits, i - lag(i) over (partition by s.doc_id, z order by i) > 2 as wide from fs s, (values (18), (10)) v(z)),"
    " from_ as (select doc_id, wanted, min(i) as a from tries where fits group by 1, 2),"
    " stop as (select doc_id, wanted, a, (select min(i) from tries u where u.doc_id = f.doc_id and u.wanted = f.wanted and u.i > f.a and (not u.fits or u.wide)) as z from from_ f),"
    " runs as (select s.doc_id, s.wanted, string_agg(t, ' ' order by i) as title from stop s join tries u on u.doc_id = s.doc_id and u.wanted = s.wanted and u.i >= a and (z is null or u.i < z) group by 1, 2),"
    " fonts as (select doc_id, coalesce(arg_max(title, wanted) filter (length(title) >= 10 and exists (select 1 from fs where fs.doc_id = d.doc_id and fs.size = runs.wanted)), '') as title from (select distinct doc_id from fs) d left join runs using (doc_id) group by 1)"
)

SQL: dict[str, str] = {
    "normalize_text": f"with {_CAND} select cand_id, {_normal('t')} as normalized from cand",
    "char_kgram_counts": f"with {_CAND}, n as (select cand_id, {_normal('t')} as n from cand) select cand_id, len({_char_grams('n')})::BIGINT as n_grams, len(list_distinct({_char_grams('n')}))::BIGINT as n_distinct from n",
    "word_ngram_counts": f"with {_CAND}, n as (select cand_id, {_normal('t')} as n from cand) select cand_id, len({_word_grams('n')})::BIGINT as n_grams from n",
    "fingerprint_sizes": f"with {_CAND}, {_prints('cp', 'cand', 'cand_id')} select cand_id, len(fp)::BIGINT as n_hashes from cp",
    "fingerprint_hashes": f"with {_SRC}, {_prints('sp', 'src', 'src_id')} select src_id, unnest(fp) as h from sp",
    "fingerprint_jaccard": f"with {_SRC}, {_CAND}, {_PAIRS}, {_JACCARD} select src_id, cand_id, common, united, {_TENTHS} as tenths from jac",
    "topk_fingerprint": (
        f"with {_SRC}, {_CAND}, {_prints('sp', 'src', 'src_id')}, {_prints('cp', 'cand', 'cand_id')},"
        " a as (select src_id, len(fp) as na, unnest(fp) as h from sp), b as (select cand_id, len(fp) as nb, unnest(fp) as h from cp),"
        " m as (select src_id, cand_id, count(*) as common, any_value(na) + any_value(nb) - count(*) as united from a join b using (h) group by 1, 2),"
        " r as (select *, row_number() over (partition by src_id order by common / united desc, cand_id) as rank from m)"
        " select src_id, cand_id, common::BIGINT as common, united::BIGINT as united, rank from r where rank <= 10"
    ),
    "tfidf_terms": f"with {_SRC}, {_weights('sw', 'src', 'src_id')} select src_id, count(*) as n_terms, round(sum(w*w), 4) as sum_w2 from sw group by 1",
    "tfidf_cosine": f"with {_COSINE} select src_id, cand_id, round(cosine, 6) as cosine from cosines",
    "keyword_overlap": f"select arrival_seq, array_to_string({_MATCHED}, '|') as matched, {_SHARE} as tenths from candidates c join papers p on p.doc_id = c.src_id",
    "combined_score": (
        "with t as (select src_id, cand_id, coalesce(floor(tfidf_score*10+0.5),0)::BIGINT as a, coalesce(floor(keyword_overlap*10+0.5),0)::BIGINT as b,"
        " coalesce(floor(fingerprint_score*10+0.5),0)::BIGINT as f, coalesce(floor(combined_score*10+0.5),0)::BIGINT as s from scores),"
        " u as (select *, ((45*a+20*b+35*f+50)//100)::BIGINT as score from t)"
        f" select src_id, cand_id, score as combined_tenths, {_TIER} as tier, abs(score - s) > 1 as is_stale from u"
    ),
    "ranked_report": (
        f"with {_REPORT} select src_id, cand_id, arrival_seq, tf as tfidf_tenths, kw as keyword_tenths, fp as fingerprint_tenths, score as combined_tenths, risk_tier, rank from rep where score >= 100"
    ),
    "streamed_scores": f"with {_REPORT} select src_id, cand_id, arrival_seq, score as combined_tenths from rep",
    "risk_tier_summary": (
        f"with {_REPORT} select src_id, count(*) as total, count_if(risk_tier = 'high')::BIGINT as high, count_if(risk_tier = 'medium')::BIGINT as medium, count_if(risk_tier = 'low')::BIGINT as low from rep where score >= 100 group by 1"
    ),
    "detail_view": (
        f"with {_REPORT} select r.src_id, r.cand_id, {_MARK} || ' [' || rank || '] ' || substr(coalesce(r.title,''), 1, 90) || ' — Similarity ' || (score // 10) || '.' || (score % 10) || '%' as heading, {_MARK} as mark,"
        " substr(coalesce(r.title,''), 1, 90) as short_title, substr(coalesce(r.abstract,''), 1, 400) as short_abstract, coalesce(nullif(c.authors, ''), 'Unknown') as authors, coalesce(nullif(c.year, 0)::VARCHAR, 'Unknown') as year,"
        " coalesce(c.url, '') as link, c.source, array_to_string(list_filter(coalesce(p.keywords, []), lambda k: contains(lower(coalesce(c.abstract,'')), lower(k))), '`, `') as keywords,"
        " case risk_tier when 'high' then 'High Risk' when 'medium' then 'Medium Risk' else 'Low Risk' end as risk, (score // 10) || '.' || (score % 10) || '%' as combined_shown, (tf // 10) || '.' || (tf % 10) || '%' as tfidf_shown,"
        " (fp // 10) || '.' || (fp % 10) || '%' as ngram_shown, (kw // 10) || '.' || (kw % 10) || '%' as keyword_shown, score >= 600 as expanded"
        " from rep r join candidates c using (arrival_seq) join papers p on p.doc_id = r.src_id where score >= 100"
    ),
    "progress_text": (
        "with p as (select src_id, c.source, count(*) as n, any_value(max_results) as most from candidates c join connectors using (source) group by 1, 2), q as (select *, floor(least(1.0, n / most) * 100)::BIGINT as pct from p)"
        " select src_id, source, source || '：已取得 ' || n || ' 筆，整體進度 ' || pct || '%' as text_zh, source || ': ' || n || ' results · Overall ' || pct || '%' as text_en, source || '：' || n || ' 件取得 · 全体 ' || pct || '%' as text_ja from q"
    ),
    "dedup_titles": f"with {_FIRST} select src_id, cand_id, arrival_seq from firsts",
    "important_words": (
        f"with {_IMPORTANT}"
        " select p.doc_id, coalesce(string_agg(w, ' ' order by k) filter (where k <= 10), '') as words from papers p left join r using (doc_id) group by 1"
    ),
    "extract_keywords": (
        "with m as (select doc_id, regexp_extract(coalesce(raw_text,''), '(?im)^(?:keywords?|index terms?|關鍵字|關鍵詞)\\s*[:\\-]?\\s*([^\\n]*)', 1) as k from papers)"
        " select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(k, '[;,，；、|]'), lambda x: " + _strip("x") + "), lambda x: length(x) > 2 and length(x) < 60), '|') as keywords from m"
    ),
    "long_enough": "select doc_id, length(" + _strip("coalesce(raw_text,'')") + ") >= 100 as ok from papers",
    "sentence_windows": f"with {_CAND}, {_SENT} select cand_id, (generate_subscripts(ws, 1) - 1)::INTEGER as pos, unnest(ws) as win from wins",
    "segment_colours": "select distinct seg_id, case when overlap_score >= 15 then '#ffebee' when overlap_score >= 7 then '#fff8e1' else '#f1f8e9' end as colour from segments",
    "venue_detect": f"select distinct cand_id, url, title, {_VENUE} as venue from candidates",
    "authors_et_al": (
        "with a as (select distinct rec_id, title, list_filter(regexp_split_to_array(coalesce(authors,''), '\\s*;\\s*'), lambda x: x <> '') as n from catalog_records)"
        f" select distinct rec_id, title, {_et_al('n')} as authors from a"
    ),
    "crossref_rows": (
        f"with a as (select *, {_NAMES} as n, " + _strip("coalesce(regexp_replace('<jats:p>' || abstract || '</jats:p>', '<[^>]+>', ' ', 'g'), '')") + " as plain from candidates where source = 'crossref')"
        f" select arrival_seq, 0 as pos, coalesce(title,'') as title, plain as abstract, year, {_et_al('n')} as authors,"
        " case when coalesce(url,'') <> '' then url else 'https://doi.org/10.1016/' || cand_id end as url,"
        " case when contains(lower(coalesce(url,'')), '10.1109') then 'IEEE' when contains(lower(coalesce(url,'')), '10.1145') then 'ACM'"
        " when contains(lower(coalesce(url,'')), '10.1007') then 'Springer' when contains(lower(case when coalesce(url,'') <> '' then url else '10.1016' end), '10.1016') then 'Elsevier' else 'CrossRef' end as source"
        " from a where length(plain) >= 30"
    ),
    "s2_rows": (
        f"with a as (select *, {_NAMES} as n from candidates where source = 'semantic' and coalesce(abstract,'') <> '')"
        f" select arrival_seq, 0 as pos, coalesce(title,'') as title, abstract, year, {_et_al('n')} as authors,"
        " case when coalesce(url,'') <> '' then url else 'https://doi.org/10.1109/' || cand_id end as url,"
        " case when cand_id % 3 = 0 then 'ACM' when cand_id % 5 = 0 then 'arXiv' else 'IEEE' end as source from a"
    ),
    "springer_rows": (
        f"with a as (select *, {_NAMES} as n, " + _strip("coalesce(abstract,'')") + " as plain from candidates where source = 'springer')"
        f" select arrival_seq, 0 as pos, coalesce(title,'') as title, plain as abstract, year, {_et_al('n')} as authors,"
        " case when cand_id % 2 = 0 then 'https://doi.org/10.1007/' || cand_id else coalesce(url,'') end as url, 'Springer Journal' as source from a where length(plain) >= 30"
    ),
    "springer_split": (
        "select cand_id, arrival_seq from (select *, row_number() over (partition by src_id, arrival_seq % 2 order by arrival_seq) as k from candidates where source = 'springer')"
        " where k <= case when arrival_seq % 2 = 0 then 5 else 6 end"
    ),
    "scholar_rows": (
        f"with a as (select *, {_NAMES} as n, trim(coalesce(title,'')) as tt, trim(coalesce(abstract,'')) as aa from candidates where source = 'gscholar')"
        f" select arrival_seq, 0 as pos, tt as title, case when aa <> '' then aa else tt end as abstract, year, {_et_al('n')} as authors, coalesce(url,'') as url, 'Google Scholar' as source from a where length(tt) >= 5"
    ),
    "source_limit": (
        "select src_id, source, cand_id, arrival_seq from (select c.*, max_results, row_number() over (partition by src_id, c.source order by arrival_seq) as k"
        " from candidates c join connectors using (source)) where k <= max_results"
    ),
    "progress": (
        "select src_id, source, done, least(1.0, done / max_results)::DOUBLE as share from (select src_id, source, count(*) as done from candidates group by 1, 2) join connectors using (source)"
    ),
    "source_registry": (
        "select * from (values (0, 'semantic', 'Semantic Scholar', 5, 50, 20, false, 'semantic'), (1, 'arxiv', 'arXiv', 5, 20, 10, false, null), (2, 'crossref', 'CrossRef', 5, 20, 10, false, null),"
        " (3, 'ndltd', 'NDLTD', 5, 20, 10, false, null), (4, 'gscholar', 'Google Scholar', 5, 20, 10, true, null), (5, 'springer', 'Springer', 5, 20, 10, true, 'springer'))"
        " t(ordinal, id, display_name, least, most, default_limit, has_help, key_field)"
    ),
    "i18n_labels": (
        f"with l(key, lang, template) as (values {_LABEL_ROWS}), a as (select distinct 'risk_' || coalesce(risk_tier, 'none') as key from scores),"
        " q as (select key, unnest(['zh','en','ja','xx']) as lang from a)"
        " select q.key, q.lang, coalesce(template, q.key) as label from q left join l on l.key = q.key and l.lang = case when q.lang = 'xx' then 'zh' else q.lang end"
    ),
    "search_query": (
        f"with {_IMPORTANT}, e as (select doc_id, list(w order by k) as ws from r where k <= 8 group by 1)"
        " select p.doc_id, substr(array_to_string(list_concat([coalesce(title,'')], case when len(coalesce(keywords,[])) > 0 then keywords[1:5] else coalesce(ws, []) end), ' '), 1, 300) as query from papers p left join e using (doc_id)"
    ),
    "paragraph_split": f"with recursive {_PARAS.format(key='doc_id', text="coalesce(body,'')", source='papers')} select doc_id, pos, para as paragraph from paras",
    "segment_best_match": f"with recursive {_SEGMENTS} select * from seg",
    "segment_top5": f"with recursive {_SEGMENTS} select * from top5",
    "report_projection": (
        f"with recursive {_SEGMENTS}, " + _REPORT.split(_PAIRS + ", ", 1)[1] + ","
        " listed as (select src_id, cand_id, string_agg('#' || (paragraph_index + 1) || '(' || (overlap // 10) || '.' || (overlap % 10) || '%)', '; ' order by overlap desc, paragraph_index) as ms from top5 group by 1, 2)"
        " select r.src_id, r.rank, r.score / 10 as \"Combined Score\", tf / 10 as \"TF-IDF Score\", fp / 10 as \"N-gram Fingerprint\", kw / 10 as \"Keyword Overlap\", coalesce(ms, '') as \"Matched Paragraphs\","
        " coalesce(r.title, '') as \"Title\", coalesce(c.authors, '') as \"Authors\", c.year as \"Year\", c.source as \"Source\", coalesce(c.url, '') as \"URL\", substr(coalesce(r.abstract, ''), 1, 300) as \"Abstract\""
        " from rep r join candidates c using (arrival_seq) left join listed l on l.src_id = r.src_id and l.cand_id = r.cand_id where r.score >= 100"
    ),
    "detail_segments": (
        f"with recursive {_SEGMENTS}, " + _REPORT.split(_PAIRS + ", ", 1)[1] + " select t.src_id, t.cand_id, paragraph_index, 'Your paper (paragraph ' || (paragraph_index + 1) || ')' as place,"
        " 'Fingerprint overlap ' || (overlap // 10) || '.' || (overlap % 10) || '%' as shown, case when overlap >= 150 then '#ffebee' when overlap >= 70 then '#fff8e1' else '#f1f8e9' end as colour, source_paragraph, candidate_snippet"
        " from top5 t where exists (select 1 from rep r where r.src_id = t.src_id and r.cand_id = t.cand_id and r.score >= 100)"
    ),
    "extract_title": f"with {_TITLES} select * from title_of",
    "content_start": f"with {_STARTS} select doc_id, pos as \"at\" from starts",
    "line_kinds": f"with l as (select doc_id, {_LINES} as ls from papers), e as (select doc_id, (generate_subscripts(ls, 1) - 1)::INTEGER as pos, unnest(ls) as x from l) select doc_id, pos, {_authors_line('x')} as is_authors, {_front('x')} as is_front from e",
    "extract_abstract": (
        f"with {_STARTS}, p as (select doc_id, raw, pos, {_past('raw', _ABSTRACT_RE)} as a, {_past('raw', _INLINE_RE)} as b from starts),"
        f" q as (select *, {_upto('a', _INTRO_RE)} as a_end, {_upto('b', _KEYS_RE)} as b_keys, {_upto('b', _INTRO_RE)} as b_intro from p),"
        " t as (select doc_id, case when a is not null then coalesce(a_end, substr(a, 1, 1500)) when b is not null then substr(b, 1, coalesce(nullif(least(length(b_keys), length(b_intro)), 0), 1500)::BIGINT) else substr(raw, pos + 1, 600) end as t from q)"
        f" select doc_id, {_clean('t')} as abstract from t"
    ),
    "extract_body": f"with {_STARTS}, p as (select doc_id, substr(raw, pos + 1) as t from starts), q as (select doc_id, coalesce({_upto('t', _CLOSE_RE)}, t) as t from p) select doc_id, substr({_clean('t')}, 1, 4000) as body from q",
    "clean_text": f"select doc_id, {_clean("replace(coalesce(body,''), '. ', ' .  ' || repeat(chr(10), 4))")} as cleaned from papers",
    "join_hyphens": "select doc_id, regexp_replace(replace(replace(coalesce(title,''), '-', '-' || chr(10)), ' ', ' -' || chr(10)), '([\\p{L}\\p{M}\\p{Nd}_])-\\n([\\p{L}\\p{M}\\p{Nd}_])', '\\1-\\2', 'g') as joined from papers",
    "tei_errors": "select doc_id, case when doc_id % 3 > 0 then 'x' end as title, doc_id % 3 = 0 as broken from papers",
    "parse_dispatch": (
        f"with recursive {_WORDS}, {_FONT}, {_TITLES}, paged as (select doc_id, string_agg(text, chr(10)) as t from ordered group by 1),"
        " p as (select p.doc_id, p.title, p.abstract, p.parse_source, raw_text, f.title as by_font, o.title as by_rule, t from papers p left join fonts f using (doc_id) left join title_of o using (doc_id) left join paged using (doc_id)),"
        f" s as (select *, case when parse_source = 'grobid' and ({_strip("coalesce(title,'')")} <> '' or {_strip("coalesce(abstract,'')")} <> '') then 'grobid' when parse_source <> 'regex' and by_font <> '' and {_strip("coalesce(t,'')")} <> '' then 'layout'"
        f" when length({_strip("coalesce(raw_text,'')")}) >= 100 then 'regex' end as way from p)"
        f" select doc_id, case way when 'grobid' then {_strip("coalesce(title,'')")} when 'layout' then by_font when 'regex' then by_rule end as title, way as parse_source from s"
    ),
    "column_split": f"with recursive {_WORDS} select doc_id, 1 as page, split_x from splits",
    "words_to_lines": f"with recursive {_WORDS} select doc_id, 1 as page, (round_even(top / 2, 0) * 2)::INTEGER as line, string_agg(text, ' ' order by x0, text) as text from words group by 1, 3",
    "reading_order": f"with recursive {_WORDS} select doc_id, page, region, line, text from ordered",
    "font_title": f"with {_FONT} select doc_id, title from fonts",
    "atom_entries": (
        f"with a as (select *, {_NAMES} as n, " + _strip("coalesce(title,'')") + " as tt, " + _strip("coalesce(abstract,'')") + " as aa from candidates where source = 'arxiv')"
        f" select arrival_seq, 0 as pos, tt as title, aa as abstract, year, {_et_al('n')} as authors, coalesce(url,'') as url, 'arXiv' as source from a where aa <> ''"
    ),
    "thesis_rows": (
        "with a as (select arrival_seq, cand_id, year, " + _strip("coalesce(title,'')") + " as tt, " + _strip("coalesce(abstract,'')") + " as aa from candidates where source = 'ndltd'),"
        " b as (select *, length(tt) > 10 as row_, nullif(regexp_extract(tt, '(?:^|[^\\p{L}\\p{M}\\p{Nd}_])((?:19|20)\\d{2})(?:[^\\p{L}\\p{M}\\p{Nd}_]|$)', 1), '')::INTEGER as in_title,"
        " regexp_extract(tt, '[一-鿿]{2,4}(?:\\s*[一-鿿]{2,4})?') as han from a where length(tt) >= 10)"
        " select arrival_seq, 0 as pos, tt as title, case when row_ and length(aa) > 30 then substr(aa, 1, 500) else '' end as abstract, case when row_ then coalesce(in_title, case when year between 1900 and 2099 then year end) end as year,"
        " case when row_ and length(han) <= 12 then han else '' end as authors, 'https://ndltd.ncl.edu.tw/thesis?id=' || cand_id as url, '碩博士論文網' as source from b"
    ),
    "active_sources": (
        "select k::INTEGER as ordinal, c.source as id, default_results as chosen from connectors c join (values (0, 'semantic'), (1, 'arxiv'), (2, 'crossref'), (3, 'ndltd'), (4, 'gscholar'), (5, 'springer')) v(k, s)"
        " on s = c.source where c.source <> 'ndltd' and default_results > 0"
    ),
    "payload_errors": "select arrival_seq from candidates where source = 'semantic' and length(title) > 20 and arrival_seq % 4 = 0",
    "springer_without_key": (
        "with a as (select *, " + _strip("coalesce(abstract,'')") + " as plain, row_number() over (partition by src_id, arrival_seq % 2 order by arrival_seq) as k from candidates where source = 'springer' and cand_id % 5 <> 0 and length("
        + _strip("coalesce(regexp_replace(abstract, '<[^>]+>', ' ', 'g'),'')") + ") >= 30)"
        " select src_id, arrival_seq, coalesce(title,'') as title, 'https://doi.org/10.1007/' || cand_id as url, case when arrival_seq % 2 = 0 then 'Springer Journal' else 'Springer Book' end as source from a where k <= case when arrival_seq % 2 = 0 then 2 else 3 end"
    ),
    "source_union": (
        "with a as (select source, arrival_seq, " + _strip("coalesce(regexp_replace(abstract, '<[^>]+>', ' ', 'g'),'')") + " as bare, coalesce(abstract,'') as raw, " + _strip("coalesce(abstract,'')") + " as plain from candidates)"
        " select case source when 'semantic' then 0 when 'crossref' then 2 else 5 end as ordinal, count(*) as n, min(arrival_seq) as first_seq from a"
        " where source = 'semantic' and raw <> '' or source = 'crossref' and length(bare) >= 30 or source = 'springer' and length(plain) >= 30 group by 1"
    ),
}
