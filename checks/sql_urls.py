"""SQL twins of the URL, link and rule-mining queries."""

from __future__ import annotations

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"

URLS = f"""
host_urls as (
  select page_id, url, html, {HOST} as host from pages
),
site_pages as (
  select page_id, url, html, host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) as site from host_urls
),
shapes as (
  select page_id, site, url,
         case when len(parts) = 0 then [''] else parts end as nodes,
         array_to_string(parts, '/') as short_url
  from (select page_id, site, url, list_filter(str_split(url, '/')[4:], lambda x: x <> '') as parts from site_pages)
),
kinds as (
  select *, len(nodes) as n_nodes, length(short_url) as short_len,
         (select count(*) from unnest(['?', '&', '=', '.', '_', '+']) t(m) where contains(short_url, m)) as n_kinds
  from shapes
),
length_stats as (
  select site, count(*) as n, sum(short_len) as s1, sum(short_len * short_len) as s2,
         min(short_len) as lo, max(short_len) as hi
  from kinds group by site
),
usual as (
  select k.* from kinds k join length_stats s using (site)
  where s.lo = s.hi
     or abs(short_len - s1 / n) < 2 * sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0))
)"""

MARKS = "?&=._+-%#~!$''()*,:;@[]{}|\\^\"<>` "


def _escape(expr: str) -> str:
    return rf"regexp_replace({expr}, '[][\\.*+?^${{}}()|]', '\\\0', 'g')"


def _prefix(low: str, high: str) -> str:
    return (
        f"list_max(list_filter(range(0, least(length({low}), length({high})) + 1), "
        f"lambda i: substr({low}, 1, i) = substr({high}, 1, i)))"
    )


MINED = f"""
positions as (
  select site, n_nodes, n_kinds, unnest(nodes) as node, unnest(range(len(nodes))) as pos from usual
),
ends as (
  select site, n_nodes, n_kinds, pos, count(*) as support, min(node) as low, max(node) as high,
         min(reverse(node)) as low_rev, max(reverse(node)) as high_rev, min(length(node)) as min_len
  from positions group by all
),
heads as (
  select *, {_prefix('low', 'high')} as head_len, {_prefix('low_rev', 'high_rev')} as tail_raw from ends
),
frames as (
  select *, case when low = high or head_len + tail_raw > min_len then 0 else tail_raw end as tail_len from heads
),
middles as (
  select f.site, f.n_nodes, f.n_kinds, f.pos,
         substr(p.node, f.head_len + 1, length(p.node) - f.head_len - f.tail_len) as middle
  from frames f join positions p using (site, n_nodes, n_kinds, pos)
),
letters as (
  select distinct site, n_nodes, n_kinds, pos, unnest(str_split(middle, '')) as c from middles where middle <> ''
),
classes as (
  select site, n_nodes, n_kinds, pos,
         coalesce(string_agg(case when c in ('-', '[', ']', '\\', '^') then '\\' || c else c end, ''
                    order by strpos('{MARKS}', c)) filter (where strpos('{MARKS}', c) > 0), '')
         || case when bool_or(ord(c) > 127) then '\\x{{80}}-\\x{{10FFFF}}' else '' end as marks,
         coalesce(bool_or(regexp_matches(c, '[A-Za-z]')), false) as wordy
  from letters group by all
),
node_rules as (
  select f.*, substr(low, 1, head_len) as prefix, reverse(substr(low_rev, 1, tail_len)) as suffix,
         coalesce(marks, '') as marks, coalesce(wordy, false) as wordy,
         case when min_len = head_len + tail_len then '*' else '+' end as many
  from frames f left join classes c using (site, n_nodes, n_kinds, pos)
),
regexes as (
  select site, n_nodes, n_kinds, pos, support, prefix, suffix,
         case when low = high and low = '' then '.*'
              when low = high then {_escape('low')}
              else {_escape('prefix')}
                || case when marks = '' then case when wordy then '\\w' else '\\d' end || many
                        else '[' || marks || case when wordy then '\\w' else '\\d' end || ']' || many end
                || {_escape('''case when not wordy then suffix
                         when pos = n_nodes - 1 then regexp_replace(regexp_replace(suffix, '^[A-Za-z0-9_]+', ''), '[A-Za-z0-9_]+$', '')
                         else regexp_replace(suffix, '^[A-Za-z0-9_]+', '') end''')}
         end as regex
  from node_rules
),
rules as (
  select site, n_nodes, n_kinds, '.*/' || string_agg(regex, '/' order by pos) as regex, max(support) as support
  from regexes group by site, n_nodes, n_kinds
),
ranked as (
  select *, row_number() over (partition by site order by support desc, n_nodes, n_kinds, regex) as rank from rules
)"""

LINKS = r"""
pieces as (
  select page_id, url as page_url,
         list_filter(str_split(regexp_replace(
           regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)(<a[\s>]|<area[\s>]|</a\s*>)', chr(1) || '\1', 'g'), chr(1)),
           lambda x: regexp_matches(x, '(?is)^<a(rea)?\s[^>]*\bhref\s*=[^>]*>')) as tags
  from pages
),
tagged as (
  select page_id, page_url, unnest(tags) as piece, unnest(range(len(tags))) as pos from pieces
),
links as (
  select page_id, pos, href, regexp_extract(page_url, '^(https?://[^/?#]*)', 1) || href as url, link_text
  from (
    select page_id, pos, page_url,
           regexp_extract(piece, '(?is)href="([^"]*)"', 1) as href,
           replace(trim(regexp_replace(regexp_extract(piece, '(?s)^[^>]*>(.*)$', 1), '<[^>]*>?', '', 'g'), E' \t\n\r'), E'\n', '') as link_text
    from tagged
  )
)"""

ROUTED = """
routed as (
  select *, case when regexp_matches(url, '[aeiou]$') then 'article'
                 when not regexp_matches(url, '[aeiou]$') then 'follow' end as route
  from links
)"""

DATED = """
dated as (
  select o_orderkey, 'http://a.example.com/' ||
    case o_orderkey % 12
      when 0 then strftime(o_orderdate, '%Y-%-m-%-d')
      when 1 then strftime(o_orderdate, '%Y-%-m/%-d')
      when 2 then strftime(o_orderdate, '%Y/%-m-%-d')
      when 3 then strftime(o_orderdate, '%Y/%-m/%-d')
      when 4 then strftime(o_orderdate, '%Y%m/%-d')
      when 5 then strftime(o_orderdate, '%Y/%m%d')
      when 6 then strftime(o_orderdate, '%Y%m-%d')
      when 7 then strftime(o_orderdate, '%Y%m/t%Y%m%d_1')
      when 8 then strftime(o_orderdate, '%Y%m%d')
      when 9 then strftime(o_orderdate, '%Y%m')
      when 10 then strftime(o_orderdate, '%Y%m') || '99'
      else 'news' end || '/' || o_orderkey || '.html' as url,
    case when o_orderkey % 12 = 9 then date_trunc('month', o_orderdate)
         when o_orderkey % 12 < 9 then o_orderdate end as true_date
  from orders
)"""

BLOCKED = ("'信箱','站点地图','末页','关于我们','版权声明','浏览建议','关于','通知公告','上一页','广告','友情链接','声明','隐私保护','留言',"
           "'网站地图','通知','公告','法律声明','网站致谢','天气','在线留言','天气预报','网站声明','联系我们','法律责任','广告合作','更正',"
           "'下一页','详情','尾页','上页','下页'")

ORACLES = {
    "read_pages": "select page_id, url, length(html) as html_chars from pages",
    "url_nodes": f"with {URLS} select page_id, short_url, case when short_url = '' then 0 else n_nodes end as n_nodes from kinds",
    "url_special_kinds": f"with {URLS} select page_id, n_kinds from kinds",
    "registered_domain": f"""with {URLS}, cut as (
        select page_id, host, case when host like '%.example.net' then 'example.net' else regexp_extract(host, '([^.]+)$', 1) end as suffix from site_pages),
      rest as (select *, substr(host, 1, length(host) - length(suffix) - 1) as lead from cut)
      select page_id, host, suffix, regexp_extract(lead, '([^.]+)$', 1) as label,
             regexp_replace(lead, '[.]?[^.]+$', '') as subdomain,
             regexp_extract(lead, '([^.]+)$', 1) || '.' || suffix as domain from rest""",
    "site_hosts": f"with {URLS} select site as domain, host, count(*) as n_urls from site_pages group by all",
    "site_root": "select page_id, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) as root from pages",
    "url_date": f"with {DATED} select o_orderkey, url, strftime(true_date, '%Y-%m-%d') as url_date from dated",
    "filter_url_recency": f"""with {DATED} select o_orderkey, url from dated
        where true_date is null or date_diff('day', cast(true_date as date), date '1998-06-30') <= 365""",
    "resolve_url": """with hrefs as (
        select page_id, url, ['/The/x.html', 'news/a.html', '../up/b.html', '?q=1', '#f', '//other.example.com/z',
               'https://abs.example.org/p?x=1', './here/../c.html'][cast(page_id % 8 as int) + 1] as href from pages),
      parts as (select *, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) as root,
               split_part(split_part(url, '#', 1), '?', 1) as bare, split_part(url, '#', 1) as whole from hrefs),
      folders as (select *, regexp_replace(bare, '[^/]*$', '') as folder from parts),
      joined as (select *, case page_id % 8
            when 0 then root || href when 3 then bare || href when 4 then whole || href
            when 5 then split_part(url, '/', 1) || href when 6 then href else folder || href end as raw from folders)
      select page_id, href, regexp_replace(regexp_replace(raw, '/[.]/', '/'), '/[^/]+/[.][.]/', '/') as resolved from joined""",
    "extract_links": f"with {LINKS} select page_id, pos, href, url, link_text from links",
    "dedup_links": f"with {LINKS} select page_id, url, min(pos) as pos, arg_min(link_text, pos) as link_text from links group by all",
    "filter_anchor_text": f"""with {LINKS}, mixed as (select page_id, pos,
          case when pos = 0 then '下一页' when pos = 1 then cast(page_id as varchar) when pos = 2 then '' else link_text end as link_text from links)
        select * from mixed where link_text not in ({BLOCKED}) and not regexp_matches(link_text, '^[0-9]+$')""",
    "filter_file_urls": """with made as (select page_id, case page_id % 5 when 0 then url || '/b.pdf' when 1 then url || '/b.PDF'
          when 2 then url || '/b.Pdf' when 3 then url || '&f=pdf' else url end as url from pages)
        select page_id, url from made
        where not list_has_any(regexp_split_to_array(split_part(split_part('/' || regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '#', 1), '?', 1), '[/_.-]'),
          ['pdf','doc','jpg','png','xls','docx','gif','csv','PDF','DOC','JPG','PNG','XLS','DOCX','GIF','CSV'])""",
    "filter_allow_deny": f"with {LINKS}, {ROUTED} select page_id, pos, url, route from routed where route is not null",
    "filter_in_domain": f"with {URLS} select page_id, host from site_pages where host = 'example.net' or host like '%.example.net'",
    "filter_url_outliers": f"with {URLS} select page_id, site, url from usual",
    "sample_links": f"""with {LINKS}, {ROUTED}, ordered as (
          select *, row_number() over (partition by page_id, route order by md5(url || '0'), pos) as rn,
                 count(*) over (partition by page_id, route) as n from routed)
        select page_id, route, url from ordered where rn <= floor(n * 0.5)""",
    "cap_pages_per_site": f"""with {URLS}, ordered as (select *, row_number() over (partition by site order by page_id) as rn from site_pages)
        select site, page_id from ordered where rn <= 100""",
    "link_frontier": """with recursive n as (select count(*) as n from pages),
      edges as (select a.url as src, b.url as dst from pages a, range(3) k(k), n
                join pages b on b.page_id = (a.page_id * 7 + k.k) % n.n),
      walk(url, hop) as (
        select url, 0 from pages where page_id = 1
        union
        select e.dst, w.hop + 1 from walk w join edges e on e.src = w.url where w.hop < 3)
      select url, min(hop) as hop from walk group by url""",
    "url_buckets": f"with {URLS} select site, n_nodes, n_kinds, count(*) as support from kinds group by all",
    "common_prefix": f"""with {URLS}, lows as (select site, min(short_url) as low, max(short_url) as high from kinds group by site)
        select site, substr(low, 1, {_prefix('low', 'high')}) as prefix from lows""",
    "common_suffix": f"""with {URLS}, groups as (select site, n_kinds, list(reverse(short_url)) as urls from kinds group by all)
        select site, n_kinds, reverse(substr(urls[1], 1, list_max(list_filter(range(0, length(urls[1]) + 1),
               lambda i: list_bool_and(list_transform(urls, lambda u: starts_with(u, substr(urls[1], 1, i)))))))) as suffix from groups""",
    "node_regex": f"with {URLS}, {MINED} select site, n_nodes, n_kinds, pos, regex, prefix, suffix, support from regexes",
    "url_rules": f"with {URLS}, {MINED} select site, regex, n_nodes, n_kinds, support, rank from ranked where rank <= 5",
    "best_site_rule": f"""with {URLS}, {MINED}, wanted as (select distinct site from site_pages union select 'nothing.example')
        select site, coalesce(regex, '') as article_regex from wanted left join (select * from ranked where rank = 1) using (site)""",
    "filter_by_rule": f"""with {URLS}, {MINED} select p.page_id, p.url, r.regex as article_regex
        from site_pages p join ranked r on p.site = r.site and r.rank = 1 and regexp_matches(p.url, r.regex)""",
}
