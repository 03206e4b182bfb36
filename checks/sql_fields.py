"""SQL twins of the title, field, selector, media, record and table queries."""

from __future__ import annotations

from checks.expected import AUTHOR_PATTERNS, CLIMBED_TAGS, DEFAULTS, EDITOR_PATTERNS, SOURCE_PATTERNS
from checks.sql_dom import BLANKS, MEASURES, flat, over
from checks.sql_urls import MINED, URLS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bag(expr: str) -> str:
    """Words of a text: runs of two or more word characters, bigrams of Chinese runs."""
    return (
        rf"list_concat(regexp_extract_all(regexp_replace(lower({expr}), '[一-龥]', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}'), "
        rf"flatten(list_transform(regexp_extract_all({expr}, '[一-龥]{{2,}}'), "
        "lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"
    )


TITLES = rf"""
titles as materialized (
  select c.page_id, trim(coalesce(string_agg(t.text, '' order by t.seq), ''), {BLANKS}) as title
  from cut c left join (select x.page_id, x.seq, x.text from texts x join nodes n
       on n.page_id = x.page_id and n.tag = 'title' and n.seq < x.seq and n.end_seq > x.seq) t using (page_id)
  group by c.page_id
),
heads as (select page_id, title, regexp_extract(title, '^[^-_|]*') as head from titles)"""

SIMILAR = f"""
title_words as materialized (
  select page_id, which, word, count(*) as n from (
    select page_id, 1 as which, unnest({bag('title')}) as word from heads
    union all select page_id, 2, unnest({bag('head')}) from heads) group by all
),
text_words as materialized (select page_id, seq, word, count(*) as n from (select page_id, seq, unnest({bag('text')}) as word from texts) group by all),
node_words as materialized (
  select m.page_id, m.seq, w.word, sum(w.n) as n from measures m
  join text_words w on w.page_id = m.page_id and w.seq > m.seq and w.seq < m.end_seq group by all
),
node_norms as (select page_id, seq, sum(n * n) as q from node_words group by all),
title_norms as (select page_id, which, sum(n * n) as q from title_words group by all),
dots as (
  select w.page_id, w.seq, t.which, sum(w.n * t.n) as dot from node_words w join title_words t using (page_id, word) group by all
),
similarities as (
  select d.page_id, d.seq, d.which, dot / sqrt(a.q * b.q) as score, r.rank
  from dots d join node_norms a using (page_id, seq) join title_norms b using (page_id, which) join ranked r using (page_id, seq)
),
title_nodes as materialized (
  select * from (select *, row_number() over (partition by page_id order by round(score, 12) desc, which, rank) as rn from similarities)
  where rn = 1 and score >= 0.8
)"""

HEADINGS = f"""
heading_lines as (
  select distinct t.page_id, t.seq, h.seq as heading, trim(t.text, {BLANKS}) as line from texts t
  join nodes h on h.tag in ('h1', 'h2', 'h3', 'h4', 'h5') and h.page_id = t.page_id and h.seq < t.seq and h.end_seq > t.seq
  where trim(t.text, {BLANKS}) <> ''
),
line_words as (select page_id, seq, heading, line, word, count(*) as n from (select *, unnest({bag('line')}) as word from heading_lines) group by all),
line_scores as (
  select l.page_id, l.seq, l.heading, l.line, sum(l.n * coalesce(t.n, 0)) / sqrt(sum(l.n * l.n) * any_value(b.q)) as score
  from line_words l join title_norms b on b.page_id = l.page_id and b.which = 2
  left join title_words t on t.page_id = l.page_id and t.which = 2 and t.word = l.word group by all
),
best_lines as (
  select * from (select *, row_number() over (partition by page_id order by round(score, 12) desc, seq) as rn from line_scores) where rn = 1 and score >= 0.8
),
heading_titles as (
  select h.page_id, b.heading as heading_seq, coalesce(b.line, h.head) as heading_title from heads h left join best_lines b using (page_id)
),
title_values as (
  select h.page_id, split_part(coalesce(nullif(m.text, ''), h.heading_title), chr(10), 1) as title_value
  from heading_titles h left join title_nodes t using (page_id) left join measures m on m.page_id = t.page_id and m.seq = t.seq
)"""

STRINGS = """
strings as (
  select n.page_id, n.seq, coalesce(string_agg(t.text, '' order by t.seq), '') as value
  from nodes n left join texts t on t.page_id = n.page_id and t.seq > n.seq and t.seq < n.end_seq group by all
)"""

BODY = r"""
body_nodes as (select page_id, min(seq) as seq, arg_min(end_seq, seq) as end_seq from nodes where tag = 'body' group by page_id),
bodies_text as (
  select c.page_id, coalesce(string_agg(t.text, '' order by t.seq), '') as joined, coalesce(string_agg(t.text, chr(10) order by t.seq), '') as lines
  from cut c left join body_nodes b using (page_id)
  left join texts t on t.page_id = c.page_id and (b.seq is null or (t.seq > b.seq and t.seq < b.end_seq))
  group by c.page_id
)"""

SELECTORS = f"""
ids as (
  select page_id, seq, end_seq, tag, regexp_matches(token, '\\sclass=') as has_class, class,
         case when regexp_matches(token, '\\sid=') then regexp_extract(token, '\\sid="([^"]*)"', 1) end as id
  from nodes
),
steps as materialized (
  select i.page_id, i.seq, i.end_seq, i.tag,
         case when has_class then tag || '[@class="' || class || '"]' when id is not null then tag || '[@id="' || id || '"]'
              when row_number() over w = 1 then tag else tag || '[' || row_number() over w || ']' end as step
  from ids i join family f using (page_id, seq) window w as (partition by i.page_id, f.parent_seq, i.tag order by i.seq)
),
chains as (
  select w.page_id, w.seq, list(s.step order by s.seq desc) as chain
  from wanted w join steps s on s.page_id = w.page_id and s.seq <= w.bottom and s.end_seq > w.bottom
       and (s.tag not in ('html', 'body') or s.seq = w.bottom)
  group by all
),
guessed as (
  select page_id, seq, '//' || array_to_string(list_reverse(chain[1:case when first_at is null then len(chain) else greatest(first_at, 3) end]), '/') as xpath
  from (select *, list_min(list_filter(range(1, len(chain) + 1), lambda i: contains(chain[i], '@'))) as first_at from chains)
)"""


def guess(source: str) -> str:
    """CTEs that guess the selector of the nodes (page_id, seq) of `source`."""
    wanted = f"""wanted as (
      select s.page_id, s.seq, coalesce(max(n.seq) filter (where n.tag not in ({', '.join(lit(t) for t in CLIMBED_TAGS)})), s.seq) as bottom
      from {source} s join nodes n on n.page_id = s.page_id and n.seq <= s.seq and n.end_seq > s.seq group by s.page_id, s.seq)"""
    return wanted + "," + SELECTORS


RICH = """(select p.page_id, p.url, replace(replace(replace(p.html, '<article>',
    '<div class="crumb"><a href="/r">' || r_name || '</a> > <a href="/n">' || translate(n_name, '_0123456789', 'xabcdefghij')
    || '</a></div><article><p class="meta">' || strftime(date '2019-01-01' + cast(p.page_id as integer), '%Y年%-m月%-d日') || ' 08:30 来源：'
    || translate(n_name, '_0123456789', 'xabcdefghij') || '！作者：张三 ，</p><video src="v' || p.page_id || '.mp4"></video>'),
    '</p>', '<img src="/i/' || p.page_id || '.png"></p>'), '<h1>', '<h1 id="t' || p.page_id || '">') as html
  from pages p join nation on n_nationkey = p.page_id % 25 join region on r_regionkey = n_regionkey)"""

NAMES = """
crumbs as (
  select page_id, r_name as region, replace(r_name, ' ', '') as first, translate(n_name, '_0123456789', 'xabcdefghij') as second,
         strftime(date '2019-01-01' + cast(page_id as integer), '%Y-%m-%d') || ' 08:30:00' as published
  from pages join nation on n_nationkey = page_id % 25 join region on r_regionkey = n_regionkey
)"""

STAMPS = """
stamps as (
  select o_orderkey, o_orderkey % 14 as kind, o_orderdate + to_seconds(o_orderkey % 86400) as stamp from orders
),
glued as (
  -- without a blank, two digits that can be a day are read as one: 302:51 is the 30th, 2:51
  select *, case when day(stamp) < 10 and cast(day(stamp) || left(strftime(stamp, '%H'), 1) as int) between 10 and 31
                 then day(stamp) || left(strftime(stamp, '%H'), 1) || ' ' || right(strftime(stamp, '%H'), 1)
                 else day(stamp) || ' ' || strftime(stamp, '%H') end as day_hour
  from stamps
),
dated as (
  select *, case kind
    when 0 then strftime(stamp, '%Y-%m-%d %H:%M:%S') when 1 then strftime(stamp, '%Y-%-m-%-d %H:%M') when 2 then strftime(stamp, '%Y/%-m/%-d %H:%M:%S')
    when 3 then strftime(stamp, '%Y年%-m月%-d日 %H:%M') when 4 then strftime(stamp, '%Y年%m月%d日') when 5 then strftime(stamp, '%Y/%m/%d')
    when 6 then strftime(stamp, '%Y.%m.%d') when 7 then strftime(stamp, '%-m月%-d日 %H:%M') when 8 then strftime(stamp, '%y-%m-%d %H:%M:%S')
    when 9 then strftime(stamp, '%Y-%m-%d%H:%M') when 10 then strftime(stamp, '%Y-%m-%d%H:%M:%S') when 11 then strftime(stamp, '%Y-%-m-%-d')
    when 12 then strftime(stamp, '%Y年%-m月%-d日%H:%M:%S') else '今天' end as text,
    case when kind = 12 then strftime(try_strptime(strftime(stamp, '%Y-%m-') || day_hour || strftime(stamp, ':%M:%S'), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')
      when kind in (0, 2, 10) then strftime(stamp, '%Y-%m-%d %H:%M:%S') when kind in (1, 3, 9) then strftime(stamp, '%Y-%m-%d %H:%M:00')
      when kind in (4, 5, 11) then strftime(stamp, '%Y-%m-%d 00:00:00') end as value
  from glued
)"""


def _first(text: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {lit(p)}, 1), '')" for p in patterns) + ")"


RULE_VALUES = ", ".join(f"({lit(field)}, {lit(kind)}, {at}, {lit(expr)})" for field, kind, exprs in DEFAULTS for at, expr in enumerate(exprs))

KIN = """kin as (
  select t.page_id, min(s.seq) filter (where s.seq < t.seq) as lead_seq, min(s.seq) filter (where s.seq > t.seq) as sub_seq
  from title_nodes t join family f using (page_id, seq) join family s on s.page_id = t.page_id and s.parent_seq = f.parent_seq and s.seq <> t.seq
  group by t.page_id
)"""

SOURCES = """inner_nodes as (
  select c.page_id, n.seq, n.end_seq, n.tag, regexp_replace(n.token, '^<[A-Za-z][A-Za-z0-9:-]*', '<' || n.tag) as token
  from content c join nodes n on n.page_id = c.page_id and n.seq >= c.seq and n.seq < c.end_seq
),
pieces as (
  select page_id, seq as place, 1 as rank, 0 as tie, token as piece from inner_nodes
  union all select page_id, end_seq, 0, -seq, '</' || tag || '>' from inner_nodes where end_seq > seq + 1
  union all select c.page_id, t.seq, 1, 0, replace(replace(replace(t.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    from content c join texts t on t.page_id = c.page_id and t.seq > c.seq and t.seq < c.end_seq
),
sources as (select page_id, md5(string_agg(piece, '' order by place, rank, tie)) as htmlcontent from pieces group by page_id),
pictures as (
  select c.page_id, string_agg(regexp_extract(n.token, 'src="([^"]*)"', 1), ' ' order by n.seq) as images
  from content c join nodes n on n.tag = 'img' and n.page_id = c.page_id and n.seq > c.seq and n.seq < c.end_seq group by c.page_id
)"""

# every link once, all under one site, as the link file has them
ALL_LINKS = URLS.replace("select page_id, url, html,", "select min(page_id) as page_id, url, '' as html,", 1).replace("as host from pages", "as host from pages group by url").replace(
    "regexp_extract(host, '([^.]+[.][^.]+)$', 1) as site", "'' as site"
)
# sites as a list of links has them: scheme and host
ROOTED = URLS.replace("regexp_extract(host, '([^.]+[.][^.]+)$', 1) as site", "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) as site")

T = f"{over()}, {MEASURES}, {TITLES}, {SIMILAR}"
R = f"{over(RICH)}, {MEASURES}, {TITLES}, {SIMILAR}, {HEADINGS}"

ORACLES = {
    "node_text": f"with {over()}, {MEASURES} select page_id, md5(text) as digest, length(text) as chars from content",
    "body_text": f"with {over()}, {BODY} select page_id, md5(joined) as joined, md5(lines) as lines from bodies_text",
    "outer_html": f"""with {over()}, {MEASURES}, inner_nodes as (
          select c.page_id, n.seq, n.end_seq, n.tag, regexp_replace(n.token, '^<[A-Za-z][A-Za-z0-9:-]*', '<' || n.tag) as token
          from content c join nodes n on n.page_id = c.page_id and n.seq >= c.seq and n.seq < c.end_seq),
        parts as (
          select page_id, seq as place, 1 as rank, 0 as tie, token as piece from inner_nodes
          union all select page_id, end_seq, 0, -seq, '</' || tag || '>' from inner_nodes where end_seq > seq + 1
          union all select c.page_id, t.seq, 1, 0, replace(replace(replace(t.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
            from content c join texts t on t.page_id = c.page_id and t.seq > c.seq and t.seq < c.end_seq)
        select page_id, md5(string_agg(piece, '' order by place, rank, tie)) as digest from parts group by page_id""",
    "page_title": f"with {over()}, {TITLES} select page_id, title, head from heads",
    "word_counts": f"select doc_id, word, count(*) as n from (select doc_id, unnest({bag('text')}) as word from documents) group by all",
    "cosine_scores": f"""with {over()}, {MEASURES}, {TITLES}, pairs as (
          select h.page_id, m.seq, h.title as a, m.text as b from heads h join measures m on m.page_id = h.page_id and m.tag = 'p'
          union all select h.page_id, -1, h.title, o.title from heads h join heads o on o.page_id = h.page_id + 1),
        words as materialized (select page_id, seq, side, word, count(*) as n from (
          select page_id, seq, 'a' as side, unnest({bag('a')}) as word from pairs
          union all select page_id, seq, 'b', unnest({bag('b')}) from pairs) group by all),
        norms as (select page_id, seq, sum(n * n) filter (where side = 'a') as qa, sum(n * n) filter (where side = 'b') as qb from words group by all),
        dot as (select page_id, seq, sum(x.n * y.n) as dot from words x join words y using (page_id, seq, word) where x.side = 'a' and y.side = 'b' group by all)
        select page_id, seq, round(case when qa is null and qb is null then -1 when qa is null or qb is null then 0
               else coalesce(dot, 0) / sqrt(qa * qb) end, 6) as score
        from pairs left join norms using (page_id, seq) left join dot using (page_id, seq)""",
    "title_node": f"with {T} select page_id, t.seq, round(t.score, 6) as score from cut left join title_nodes t using (page_id)",
    "heading_title": f"with {T}, {HEADINGS} select page_id, heading_seq, heading_title from heading_titles",
    "title_value": f"with {T}, {HEADINGS} select page_id, title_value from title_values",
    "sibling_titles": f"""with {T}, {STRINGS}, kin as (
          select t.page_id, max(case when s.seq is null then 0 else 1 end) as any_kin, min(s.seq) filter (where s.seq < t.seq) as lead_seq, min(s.seq) filter (where s.seq > t.seq) as sub_seq
          from title_nodes t join family f using (page_id, seq) left join family s on s.page_id = t.page_id and s.parent_seq = f.parent_seq and s.seq <> t.seq
          group by t.page_id)
        select c.page_id, md5(l.value) as leadtitle, md5(s.value) as subtitle from cut c left join kin k using (page_id)
        left join strings l on l.page_id = c.page_id and l.seq = k.lead_seq left join strings s on s.page_id = c.page_id and s.seq = k.sub_seq""",
    "first_match_field": f"""with made as (
          select c_custkey, '前文 ' || case c_custkey % 8 when 0 then '作者：' when 1 then '原创|' when 2 then '撰文:' when 3 then '文/图 '
              when 4 then '责任编辑：' when 5 then '记者 ' when 6 then '来源于：' else '无 ' end || c_name || '！' || c_mktsegment as text from customer)
        select c_custkey, trim({_first('text', AUTHOR_PATTERNS)}) as author, trim({_first('text', EDITOR_PATTERNS)}) as editor,
               trim({_first('text', SOURCE_PATTERNS)}) as source from made""",
    "first_match_by_site": """with made as (
          select c_custkey, c_nationkey % 2 as side, c_name as name from customer)
        select c_custkey, name || '!' as value, case side when 0 then '名：(.*)' else '字：(.*)' end as regex from made""",
    "publish_date": f"""with {STAMPS} select o_orderkey, case when kind <> 13 then coalesce(value, '') end as found_value from dated""",
    "normalize_date": f"with {STAMPS} select o_orderkey, text, value from dated",
    "eval_selectors": f"""with {over()}, {STRINGS}, articles as (select * from nodes where tag = 'article'),
        h1s as (select f.page_id, f.seq, v.value from family f join articles a on a.page_id = f.page_id and a.seq = f.parent_seq
                join nodes n on n.page_id = f.page_id and n.seq = f.seq and n.tag = 'h1' join strings v on v.page_id = f.page_id and v.seq = f.seq),
        ads as (select page_id, seq, value from nodes join strings using (page_id, seq) where tag in ('div', 'p') and class = 'ad'),
        navs as (select distinct n.page_id, n.seq, regexp_extract(n.token, 'href="([^"]*)"', 1) as value from nodes n
                 join nodes v on v.tag = 'nav' and v.page_id = n.page_id and v.seq < n.seq and v.end_seq > n.seq where n.tag = 'a'),
        seconds as (select page_id, seq, value from (select f.page_id, f.seq, v.value, row_number() over (partition by f.page_id, f.parent_seq order by f.seq) as rn
                 from family f join nodes n using (page_id, seq) join articles a on a.page_id = f.page_id and a.seq = f.parent_seq
                 join strings v using (page_id, seq) where n.tag = 'p') where rn = 2),
        every as (
          select page_id, '//article/h1' as xpath, row_number() over (partition by page_id order by seq) - 1 as pos, value from h1s
          union all select page_id, '//*[@class="ad"]', row_number() over (partition by page_id order by seq) - 1, value from ads
          union all select page_id, '//nav//a/@href', row_number() over (partition by page_id order by seq) - 1, value from navs
          union all select page_id, 'string(//article/p[2])', 0, arg_min(value, seq) from seconds group by page_id
          union all select page_id, '//title/text()', 0, text from texts t
            where exists (select 1 from nodes n where n.tag = 'title' and n.page_id = t.page_id and n.seq < t.seq and n.end_seq > t.seq))
        select page_id, xpath, pos, md5(value) as digest from every""",
    "selector_pool": f"""with {over()}, {STRINGS} select page_id, 'title' as field, '//h1' as xpath, md5(value) as digest
          from (select page_id, trim(string_agg(value, '' order by seq), E' \\t\\n\\r') as value from nodes join strings using (page_id, seq) where tag = 'h1' group by page_id) where value <> ''
        union all select page_id, 'author', '//footer', md5(value) from (select page_id, trim(string_agg(value, '' order by seq), E' \\t\\n\\r') as value
          from nodes join strings using (page_id, seq) where tag = 'footer' group by page_id) where value <> ''""",
    "guess_selector": f"""with {over(RICH)}, {MEASURES}, {guess('ranked')} select page_id, seq, xpath from guessed""",
    "value_selector": f"""with {over()}, {MEASURES}, {TITLES}, owners as (
          select t.page_id, t.seq, t.text, max(n.seq) as parent from texts t join nodes n on n.page_id = t.page_id and n.seq < t.seq and n.end_seq > t.seq group by all),
        firsts as (select * from (select *, row_number() over (partition by page_id, parent order by seq) as rn from owners) where rn = 1),
        holders as (select h.page_id, min(f.parent) as seq from heads h join firsts f on f.page_id = h.page_id and contains(f.text, split_part(h.title, ' ', 1)) group by h.page_id),
        {guess('holders')} select page_id, seq, 'string(' || xpath || ')' as xpath from guessed""",
    "configured_first": f"""with {over()}, {STRINGS} select page_id, 'string(//article/h1)' as xpath, md5(arg_min(value, seq)) as digest
        from nodes join strings using (page_id, seq) where tag = 'h1' and value <> '' group by page_id""",
    "drop_noise": f"""with {over()}, noise as (
          select page_id, seq, end_seq from nodes where class = 'ad' or tag = 'nav'),
        left_over as (
          select n.page_id, n.seq, n.tag, f.depth, f.parent_seq, row_number() over (partition by n.page_id order by n.seq) as at
          from nodes n join family f using (page_id, seq)
          where not exists (select 1 from noise x where x.page_id = n.page_id and x.seq <= n.seq and x.end_seq > n.seq))
        select l.page_id, l.at, l.tag, l.depth, coalesce(p.at, 0) as parent_at
        from left_over l left join left_over p on p.page_id = l.page_id and p.seq = l.parent_seq""",
    "content_images": f"""with {over(RICH)}, {MEASURES} select c.page_id, coalesce(string_agg(regexp_extract(n.token, 'src="([^"]*)"', 1), ' ' order by n.seq), '') as images
        from content c left join nodes n on n.tag = 'img' and n.page_id = c.page_id and n.seq > c.seq and n.seq < c.end_seq group by c.page_id""",
    "content_video": f"""with {over(RICH)}, {MEASURES} select c.page_id, min(regexp_extract(n.token, 'src="([^"]*)"', 1)) as video
        from content c left join raw_nodes n on n.tag = 'video' and n.page_id = c.page_id and n.seq > c.seq and n.seq < c.end_seq group by c.page_id""",
    "content_siblings": f"""with {over()}, {MEASURES}, scripted as (select p.page_id, p.parent_seq as seq from parents p join raw_nodes r using (page_id, seq) where r.tag = 'script')
        select c.page_id, f.seq from content c join family f on f.page_id = c.page_id and f.parent_seq = c.parent_seq anti join scripted s on s.page_id = f.page_id and s.seq = f.seq""",
    "breadcrumb": f"with {NAMES} select page_id, first || ' ' || second as names, '/r /n' as hrefs from crumbs",
    "breadcrumb_path": f"with {NAMES} select page_id, first || '|' || first || '>' || second as navs from crumbs",
    "breadcrumb_search": f"""with {NAMES} select page_id, '//div[@class="crumb"]//a' as xpath from crumbs""",
    "extract_records": f"""with {R}, {NAMES}, {STRINGS}, {KIN}, {SOURCES}, {guess('content')}, videos as (
          select c.page_id, min(regexp_extract(n.token, 'src="([^"]*)"', 1)) as video
          from content c join raw_nodes n on n.tag = 'video' and n.page_id = c.page_id and n.seq > c.seq and n.seq < c.end_seq group by c.page_id)
        select c.page_id, c.url, t.title_value as title, md5(m.text) as content, g.xpath as content_xpath,
          n.published as publish_date, n.second as source, '作者：张三' as author, n.first || '>' || n.second as channel, '' as editor,
          coalesce(v.video, '') as video_url, htmlcontent, coalesce(images, '') as images,
          md5(coalesce(l.value, '')) as leadtitle, md5(coalesce(s.value, '')) as subtitle
        from pages c join title_values t using (page_id) join content m using (page_id) join crumbs n using (page_id) join guessed g using (page_id) left join videos v using (page_id)
        join sources using (page_id) left join pictures using (page_id) left join kin k using (page_id)
        left join strings l on l.page_id = c.page_id and l.seq = k.lead_seq left join strings s on s.page_id = c.page_id and s.seq = k.sub_seq""",
    "extract_records_repeated_ids": f"""with {R} select page_id % 50 as page_id, url, title_value as title, md5(m.text) as content
        from title_values join content m using (page_id) join pages using (page_id)""",
    "extract_records_by_site": f"""with {R.replace("regexp_extract(title, '^[^-_|]*') as head", "case when page_id % 3 = 0 then split_part(title, 'e', 1) else regexp_extract(title, '^[^-_|]*') end as head")}, {NAMES},
        shots as (
          select i.page_id, string_agg(regexp_extract(i.token, 'src="([^"]*)"', 1), ' ' order by i.seq) as images from nodes i
          where i.tag = 'img' and exists (select 1 from nodes a where a.tag = 'article' and a.page_id = i.page_id and a.seq < i.seq and a.end_seq > i.seq) group by i.page_id)
        select page_id, title_value as title, case when page_id % 3 = 1 then '' else n.second end as source,
          case when page_id % 3 <> 0 then n.first || '>' || n.second end as channel, case when page_id % 3 = 2 then images end as images
        from title_values join crumbs n using (page_id) left join shots using (page_id)""",
    "selectors_only": f"""with {R}, {guess('content')} select page_id, 'string(' || xpath || ')' as xpath, '' as regex, 2 as parts from guessed""",
    "values_only": f"""with {R} select page_id, title_value as title, md5(m.text) as content from title_values join content m using (page_id)""",
    "field_projection": f"""with {R} select page_id, title_value as title, md5(m.text) as content from title_values join content m using (page_id)""",
    "quality_gate": """select page_id from pages where page_id % 7 not in (1, 2)
        and cast(page_id % 2 = 1 as int) + cast(page_id % 3 > 0 as int) + cast(page_id % 7 <> 3 as int) + 1 >= 3""",
    "common_selectors": f"""with {URLS} select site, field, kind, expr, count(*) as support from (
          select site, 'title' as field, 'selector' as kind, '//h' || page_id % 3 as expr from site_pages
          union all select site, 'title', 'pattern', 'p' || page_id % 2 from site_pages where page_id % 2 = 1
          union all select site, 'content', 'selector', '//div[' || page_id % 5 || ']' from site_pages) group by all""",
    "site_sample": f"""with {URLS} select site, arg_min(url, page_id) as sample,
          '{{"url":"' || arg_min(url, page_id) || '","title":{{"xpath":"x","value":"t' || min(page_id) || '","regex":""}}}}' as sample_values from site_pages group by site""",
    "upsert_site_table": f"""with {URLS}, every as (
          select host as web_name, 'j' || page_id % 4 as job_id, page_id as version, 0 as fresh, url from site_pages where page_id % 2 = 0
          union all select host, 'j' || page_id % 4, page_id, 1, url || '/new' from site_pages where page_id % 3 = 0),
        firsts as (select *, row_number() over (partition by web_name, job_id order by version desc, fresh desc) as rn from every)
        select web_name, job_id, version, url from firsts where rn = 1""",
    "load_site_config": f"""with {URLS}, hosts as (select distinct host from site_pages),
        defaults(field, kind, priority, expr) as (values {RULE_VALUES})
        select host as site, field, kind, priority, expr from hosts, defaults where host not like 'www.%'
        union all select host, 'title', 'selector', 0, '//h1' from hosts where host like 'www.%'""",
    "bump_config_version": f"""with {URLS}, exprs as (select site, max(page_id % 9) as v, list_sort(list(distinct '//p' || page_id % 6)) as xs from site_pages group by site)
        select site, v + 1 as version, '{{"title":{{"XPATH":["' || array_to_string(xs, '","') || '"],"PATTERN":["[-_|]"]}}}}' as config from exprs""",
    "site_run_rows": f"""with {URLS}, sites as (select site, count(*) as n, min(host) as host from site_pages group by site)
        select site as web_name, '["http://' || host || '"]' as start_urls, 1 as status, n as version, '["' || site || '"]' as allowed_domains,
               '.*' as article_regex, 'job' as job_id, '2020-01-02 00:00:00' as updated_at from sites""",
    "train_sites": f"""with {R}, {guess('content')},
        site_urls as materialized (with {URLS} select site, url, page_id from site_pages),
        best as materialized (with {URLS}, {MINED} select site, regex from ranked where rank = 1),
        roots as (select site, arg_min(regexp_extract(url, '^(https?://[^/?#]+)', 1), page_id) as root from site_urls group by site),
        matches as (select p.site, p.page_id from site_urls p join best b using (site) where regexp_matches(p.url, b.regex)),
        matching as (select site, min(page_id) as page_id from matches group by site),
        paths as (select site, 'string(' || xpath || ')' as path, count(*) as n from matches join guessed using (page_id) group by all),
        learned as (select site, string_agg(path, ' ' order by n desc, path) as content_xpaths from paths group by site)
        select w.site as web_name, '["' || root || '"]' as start_urls, 1 as status, 1 as version, '["' || w.site || '"]' as allowed_domains,
               b.regex as article_regex, 'job' as job_id, p.url as sample, content_xpaths, t.title_value as sample_title, md5(c.text) as sample_content
        from roots w join best b using (site) join matching m using (site) join site_urls p on p.page_id = m.page_id
        join learned l on l.site = w.site join title_values t on t.page_id = m.page_id join content c on c.page_id = m.page_id""",
    "read_link_csv": "select distinct url as link from pages",
    "read_link_lines": "select url as link from pages",
    "mine_link_lines": f"""with {ROOTED}, {MINED} select site, site || regex[3:] as regex, n_nodes, n_kinds, support, rank from ranked where rank <= 5""",
    "mine_link_csv": f"""with {ALL_LINKS}, {MINED} select regex, n_nodes, n_kinds, support, rank from ranked where rank <= 100""",
    "read_records": "select page_id, job_id, 't' || page_id as title from pages, (values ('one'), ('two')) as jobs(job_id)",
    "default_field_rules": f"""with {URLS}, defaults(field, kind, priority, expr) as (values {RULE_VALUES})
        select distinct host as site, field, kind, priority, expr from site_pages, defaults""",
    "write_records": "select page_id, url, 't' || page_id as title from pages",
    "write_links": "select url as value from pages",
    "stream_records": f"with {T}, {HEADINGS} select page_id, url, title_value as title, md5(m.text) as content from pages join title_values using (page_id) join content m using (page_id)",
    "stream_dedup_urls": "select distinct split_part(url, '?', 1) as url from pages",
    "stream_train": f"with {URLS}, {MINED} select site, regex, n_nodes, n_kinds, support, rank from ranked where rank <= 5",
}
