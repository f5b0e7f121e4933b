"""The index of vendor claims: reading, cleaning, resolving, folding and asking it."""

from __future__ import annotations

from ..functions import fixed, markup, numbers, urls
from ..plans.adapters import NOW_ORDERS
from ..plans.dialect import Dialect
from ..plans.registry import query, relation, written


def title_cased(d: Dialect, x: str) -> str:
    """Every letter that opens a word is a capital: after a blank, and after any other sign (o'neil, e.on)."""
    letter = f"CASE WHEN {{w}} = '' THEN '' ELSE concat(upper(substring({{w}}, 1, 1)), substring({{w}}, 2)) END"
    words = d.exta(x, "[A-Za-z0-9_]+|[^A-Za-z0-9_]+", 0)
    return d.join(d.each(words, "w", letter.format(w="w")), "")


def normalized_company(d: Dialect, x: str) -> str:
    return d.sub(d.sub(f"replace(lower({x}), '&', ' and ')", fixed.COMPANY_SUFFIXES), "[^a-z0-9]")


def cleaned(d: Dialect, source: str, columns: str) -> str:
    """source(raw, columns) with ``name``: a published customer name without file names, sizes and marketing words; null if it names no company."""
    ends = r"^[-–—|,.]+|[-–—|,.]+\z"
    steps = [
        (r"(?i)\.(svg|png|jpe?g|webp|gif|avif|ico|pdf)\z", ""), (r"^\*+\.?", ""), (r"(?i)\b[0-9]{2,5}px[-_ ]?", ""), (r"(?i)[-_ ][0-9]{2,5}x[0-9]{2,5}\b", ""), (r"(?i)[-_ ]seeklogo[-_ ]?[0-9]*", ""), (r"[-_ ]?\b[0-9]{6,}\b", ""), (r"_+", " "),
        *[(r"([A-Za-z0-9])-([A-Za-z0-9])", d.group(1) + " " + d.group(2))] * 2, (fixed.LOGO_WORDS, " "), (r"(?i)^\s*(ticker|carousel|slider|marquee|strip|grid|row|item|slide)[-_ ]+", ""), (r"[-_ ]+[0-9]{1,2}\z", ""), (r"\s(19|20)[0-9]{2}\z", ""),
        (r"\s+", " "), (r"^ | \z", ""), (ends, ""), (r"^ | \z", ""), (fixed.NAME_TAIL, ""), (r"^\s+|\s+\z", ""), (fixed.NAME_HEAD, ""), (r"^\s+|\s+\z", ""),
    ]
    e = "entity"
    for p, by in steps:
        e = d.sub(e, p, by)
    words = d.size(d.split(d.sub("n", r"\s+", " "), " "))
    drop = [
        "length(n) < 2 OR length(n) > 60", d.rx("n", fixed.HAS_VERB), d.rx("n", fixed.DANGLING_END), f"{d.rx('n', fixed.SENTENCE_START)} AND {words} > 2", f"{words} > 6", f"NOT {d.rx('n', '[a-zA-Z]')}", d.rx("n", fixed.PERSON),
        f"lower(n) IN ({d.strings([*fixed.NO_COMPANY, *fixed.PLATFORMS])})", f"{d.ext('lower(n)', '^([^ ]*)')} IN ({d.strings(fixed.PLATFORMS)}) AND {words} <= 3", d.rx("lower(n)", fixed.RATING),
    ]
    entity = markup.decoded(d, d.sub("raw", "&rsquo;|&#x27;", "'"))
    return f"""
SELECT {columns}, raw, CASE WHEN {' OR '.join(f'({x})' for x in drop)} THEN NULL WHEN n = lower(n) AND {d.rx('n', r"^[a-z0-9 &'.-]+$")} THEN {title_cased(d, 'n')} ELSE n END AS name FROM (SELECT {columns}, raw, {e} AS n FROM (SELECT {columns}, raw, {entity} AS entity FROM {source}))"""


@relation
def cleaned_name(d):
    return cleaned(d, "raw_name", "id")


@query
def clean_customer_name(d):
    return "SELECT id, raw, name FROM cleaned_name"


@query
def clean_logo_name(d):
    """The first pass over a logo's text."""
    n = d.trim(d.sub(d.sub(d.sub(markup.spaced(d, markup.decoded(d, "raw")), r"(?i)\s+(logo|logotype|icon|image|photo|wordmark)\z"), r"(?i)^(logo|image|photo) (of|for)\s+"), r"(?i)\s*[-|]\s*(case study|customer story|success story|testimonial).*\z"))
    return f"SELECT id, CASE WHEN length(n) < 2 OR length(n) > 60 OR NOT {d.rx('n', '[a-zA-Z]')} OR {d.rx('n', r'(?i)^(the |a )?(company|client|customer|partner|brand|team|user|logo|image|img|photo|picture|group|inc|ltd|llc|gmbh)\b')} OR {d.rx('n', r'(?i)^(https?:|www\.|/)')} OR {d.size(d.split('n', ' '))} > 7 THEN NULL ELSE n END AS name FROM (SELECT id, {n} AS n FROM raw_name)"


@query
def normalize_company(d):
    return f"SELECT id, {normalized_company(d, 'raw')} AS company_key FROM raw_name"


@query
def domain_candidates(d):
    """Addresses that a name could have: its stems under twenty suffixes, suffix by suffix, the first thirty."""
    base = d.trim(markup.spaced(d, d.sub(d.sub("replace(lower(raw), '&', 'and')", r"[`.\x27]"), "[^a-z0-9 -]", " ")))
    stems = d.explode("id", f"(SELECT id, {d.sub('base', '[ -]')} AS squashed, {d.sub(d.trim(d.sub('base', fixed.STEM_SUFFIXES)), '[ -]')} AS short, replace(base, ' ', '-') AS hyphen FROM (SELECT id, {base} AS base FROM raw_name))", d.array("squashed", "short", "hyphen"), "stem", "idx")
    tlds = ", ".join(f"({k}, '{t}')" for k, t in enumerate(fixed.CANDIDATE_TLDS))
    return f"""
SELECT id, candidate, nth FROM (SELECT id, concat(stem, tld) AS candidate, CAST(row_number() OVER (PARTITION BY id ORDER BY t.ord, s.idx) AS INTEGER) AS nth
FROM (SELECT id, stem, min(idx) AS idx FROM ({stems}) WHERE length(stem) BETWEEN 3 AND 40 GROUP BY id, stem) s CROSS JOIN (SELECT * FROM (VALUES {tlds}) AS _t(ord, tld)) t) WHERE nth <= 30"""


@query
def app_catalog_dedupe(d):
    """An app once, from the first storefront that lists it; a storefront with many rows may be cut off."""
    return """
SELECT a.vendor, a.bundle, a.store, t.truncated FROM (SELECT vendor, bundle, store, row_number() OVER (PARTITION BY vendor, bundle ORDER BY store, row_id) AS nth FROM app) a
JOIN (SELECT vendor, max(n) >= 200 AS truncated FROM (SELECT vendor, store, count(*) AS n FROM app GROUP BY vendor, store) GROUP BY vendor) t ON a.vendor = t.vendor WHERE a.nth = 1"""


@query
def pkg_extract(d):
    """Packages that a vendor's page in a store links."""
    return f"SELECT DISTINCT vendor, package FROM ({d.explode('vendor', 'store_page', d.exta('html', r'details[?]id=([A-Za-z0-9_.]+)', 1), 'package', 'idx')})"


@query
def bundle_token(d):
    """The last part of an app's id that says something."""
    parts = d.filt(d.split("lower(bundle)", "."), "p", f"p <> '' AND p NOT IN ({d.strings(fixed.BUNDLE_NOISE)})")
    return f"SELECT DISTINCT bundle, {d.sub(f'coalesce({d.at(parts, -1)}, {d.lit(chr(32))})', '[^a-z0-9-]')} AS token FROM app"


@query
def prefix_token(d):
    """What follows the longest prefix of the vendor in an app's id, else what follows its name there."""
    at = d.pos("a.bundle", "concat('.', k.vendor_key, '.')")
    after = f"CASE WHEN {at} > 0 THEN substring(a.bundle, {at} + length(k.vendor_key) + 2) END"
    return f"""
SELECT a.vendor, a.bundle, coalesce(max_by(substring(a.bundle, length(p.prefix) + 1), CASE WHEN p.prefix IS NOT NULL THEN length(p.prefix) END), nullif(min({after}), '')) AS token
FROM (SELECT DISTINCT vendor, bundle FROM app) a LEFT JOIN (SELECT vendor, vendor_key FROM vendor_rule) k ON a.vendor = k.vendor LEFT JOIN vendor_prefix p ON a.vendor = p.vendor AND {d.starts('a.bundle', 'p.prefix')} GROUP BY a.vendor, a.bundle"""


#: A vendor's name counts inside another one from five letters.
LEAST_NAME = 4


def parts(d: Dialect, source: str, columns: str, x: str, wanted: str, anywhere: bool = True) -> str:
    """columns and ``part``: what stands in x, or opens it, of the lengths that wanted(part) has. A text gives a row a length (and place), not one a pair of places; the lengths are one row."""
    lengths = f"(SELECT sort_array(collect_set(length(part))) AS ns FROM {wanted} WHERE part <> '')"
    fits = f"filter(ns, n -> n <= length({x}))"
    each = f"flatten(transform({fits}, n -> transform(sequence(1, length({x}) - n + 1), i -> substring({x}, i, n))))" if anywhere else f"transform({fits}, n -> substring({x}, 1, n))"
    return f"SELECT DISTINCT {columns}, part FROM (SELECT {columns}, {each} AS found FROM {source} CROSS JOIN {lengths}) LATERAL VIEW explode(found) _p AS part"


@query
def vendor_match(d):
    """Apps, and the vendors that claim them: by a prefix of the app's id, or by a name of over four letters within the seller's. Upper and lower case are one.

    An app is told no vendor. Spark cuts ids and sellers into the parts of the lengths that prefixes and names have, and joins those parts by equality.
    """
    squashed = d.sub("lower(a.seller)", "[^a-z0-9]")
    if not d.spark:
        return f"SELECT DISTINCT a.bundle, v.vendor FROM (SELECT DISTINCT bundle, seller FROM app) a JOIN vendor_rule v ON {d.starts('lower(a.bundle)', 'lower(v.prefix)')} OR length(v.seller_part) > {LEAST_NAME} AND {d.contains(squashed, 'v.seller_part')}"
    apps = f"(SELECT DISTINCT lower(a.bundle) AS id, a.bundle, {squashed} AS seller FROM app a)"
    return f"""
SELECT DISTINCT bundle, vendor FROM (
  SELECT p.bundle, v.vendor FROM ({parts(d, apps, 'bundle', 'id', "(SELECT lower(prefix) AS part FROM vendor_rule)", anywhere=False)}) p JOIN vendor_rule v ON p.part = lower(v.prefix)
  UNION ALL SELECT p.bundle, v.vendor FROM ({parts(d, apps, 'bundle', 'seller', f"(SELECT seller_part AS part FROM vendor_rule WHERE length(seller_part) > {LEAST_NAME})")}) p JOIN vendor_rule v ON p.part = v.seller_part AND length(v.seller_part) > {LEAST_NAME})"""


@written
def seller_domain(d):
    """Spark's form: each seller's address once, with its domain. Written, as a filter on the domain would else be moved before the grouping, to every row."""
    return f"SELECT seller_url, {urls.registrable_domain(d, 'seller_url')} AS dom FROM (SELECT DISTINCT seller_url FROM app WHERE seller_url IS NOT NULL)"


@query
def customer_rows(d):
    """Apps whose seller is the customer's own site."""
    dom = urls.registrable_domain(d, "seller_url")
    if d.spark:
        return f"SELECT DISTINCT a.vendor, a.bundle, k.dom FROM app a JOIN seller_domain k ON a.seller_url = k.seller_url WHERE k.dom NOT IN ({d.strings([*fixed.NON_CUSTOMER_HOSTS, 'freshservice.com', 'freshworks.com', 'sharepoint.com', 'microsoft.com', 'salesforce.com'])})"
    return f"SELECT vendor, bundle, dom FROM (SELECT DISTINCT vendor, bundle, {dom} AS dom FROM app) WHERE dom IS NOT NULL AND dom NOT IN ({d.strings([*fixed.NON_CUSTOMER_HOSTS, 'freshservice.com', 'freshworks.com', 'sharepoint.com', 'microsoft.com', 'salesforce.com'])})"


@query
def logo_wall_extract(d):
    tags = d.explode("id", "logo_page", d.exta("html", r"(?i)<img[^>]*>", 0), "tag", "idx")
    return f"SELECT id, {d.ext('tag', r'/([a-z0-9-]+)_[0-9]+[.][a-z]+')} AS slug, {markup.attribute(d, 'tag', 'alt')} AS alt FROM ({tags}) WHERE {d.rx('tag', r'Company[.]logo')}"


@query
def story_url_name(d):
    """The company that a story's address names: its last segment without what stories are called, cleaned like a published name. Folders of stories name none."""
    last = d.sub(f"coalesce({d.at(urls.segments(d, 'path'), -1)}, '')", r"(?i)\.(html?|php|aspx)\z")
    cut = d.sub(d.sub("slug", fixed.STORY_HEAD), fixed.STORY_TAIL)
    source = f"(SELECT id, CASE WHEN slug = '' OR {d.rx('slug', fixed.STORY_FOLDER)} OR {d.rx('slug', fixed.STORY_NONE)} OR length(cut) < 3 OR length(cut) > 45 THEN '' ELSE {title_cased(d, d.sub('cut', '[-_]+', ' '))} END AS raw FROM (SELECT id, slug, {cut} AS cut FROM (SELECT id, {last} AS slug FROM (SELECT id, {urls.path(d, 'url')} AS path FROM story))))"
    return f"SELECT id, name FROM ({cleaned(d, source, 'id')})"


@query
def former_claims(d):
    """Stories that the archive has and the live site does not."""
    return f"SELECT a.id, a.path, l.path IS NULL AS historical FROM (SELECT id, {d.sub(urls.path(d, 'url'), r'/\z')} AS path FROM story) a LEFT JOIN (SELECT DISTINCT {d.sub(urls.path(d, 'url'), r'/\z')} AS path FROM story WHERE live) l ON a.path = l.path"


@relation
def resolved_probe(d):
    token, words = d.sub("token", "[^a-z0-9]"), d.sub("lower(app_name)", "[^a-z0-9]")
    hay = d.sub("lower(title)", "[^a-z0-9]")
    return f"""
SELECT *, CASE WHEN token IN ('social', 'live', 'connect', 'hub', 'news', 'team', 'portal', 'intranet') THEN 'generic_word' WHEN NOT robots_ok THEN 'robots_blocked' WHEN status IN (401, 403, 405, 406, 429, 503) THEN 'exists_blocked' WHEN status IS NULL OR status <> 200 THEN 'no_site' WHEN body_len < 2000 THEN 'no_site'
  WHEN {d.rx('title', fixed.PARKED)} OR redirected IN ('hugedomains.com', 'sedo.com', 'dan.com', 'afternic.com') THEN 'parked' WHEN length({token}) >= 6 AND {d.contains(hay, token)} THEN 'title_match' WHEN length({words}) >= 5 AND {d.contains(hay, words)} THEN 'title_match'
  WHEN redirected <> '' AND length(token) >= 6 THEN 'redirect_owned' ELSE 'exists_only' END AS signal FROM probe"""


@query
def resolution_signal(d):
    return "SELECT id, token, signal, CASE WHEN signal IN ('title_match', 'redirect_owned') THEN 'probable' WHEN signal IN ('exists_only', 'exists_blocked') THEN 'possible' ELSE 'named_unresolved' END AS confidence FROM resolved_probe"


@query
def resolve_name(d):
    """The address of a name among its first four live candidates: a title match anywhere, else the first under a generic suffix, else the first."""
    suffix = "suffix"
    return f"""
SELECT name_id, domain, signal FROM (SELECT name_id, concat(token, {suffix}) AS domain, signal, row_number() OVER (PARTITION BY name_id ORDER BY CASE WHEN signal = 'title_match' THEN 0 ELSE 1 END, CASE WHEN {suffix} IN ('.com', '.io') THEN 0 ELSE 1 END, ord) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY ord) AS tried FROM resolved_probe WHERE status IS NOT NULL) WHERE tried <= 4 AND signal NOT IN ('no_site', 'parked', 'generic_word')) WHERE nth = 1"""


@query
def drop_vendor_names(d):
    """Names that are a vendor's own, hold one of five letters or more, or are those of an asset, are no customers."""
    vendor = normalized_company(d, d.trim(d.ext("v.name", "^([^(]*)")))
    keep = f"length(c.company_key) >= 2 AND NOT {d.rx('c.name', r'(?i)\b(website|client|template|example|sample|placeholder|asset|mockup|screenshot)\b')}"
    names = f"SELECT id, name, {normalized_company(d, 'name')} AS company_key FROM cleaned_name WHERE name IS NOT NULL"
    if d.spark:  # each distinct name once against the vendors; every part of five letters or more of it that a vendor's name could be
        vendors = f"SELECT DISTINCT vk FROM (SELECT {vendor} AS vk FROM vendor_name v) WHERE vk <> ''"
        held = parts(d, f"(SELECT DISTINCT company_key FROM ({names}) WHERE company_key <> '')", "company_key", "company_key", f"(SELECT vk AS part FROM ({vendors}))")
        hit = f"SELECT DISTINCT company_key AS k FROM ({held}) JOIN ({vendors}) ON part = vk WHERE part = company_key OR length(part) > {LEAST_NAME}"
        return f"SELECT c.id, c.name FROM ({names}) c LEFT ANTI JOIN ({hit}) h ON c.company_key = h.k WHERE {keep}"
    return f"""
SELECT c.id, c.name FROM ({names}) c WHERE {keep}
AND NOT EXISTS (SELECT 1 FROM vendor_name v WHERE {vendor} <> '' AND ({vendor} = c.company_key OR length({vendor}) >= 5 AND {d.contains('c.company_key', vendor)}))"""


@query
def low_specificity(d):
    return f"SELECT id, name, {d.size(d.split('name', ' '))} = 1 AND length({d.sub('name', '[^A-Za-z0-9]')}) <= 6 AS low_specificity FROM cleaned_name WHERE name IS NOT NULL"


@query
def fold_sources(d):
    """Claims of all sources, one a vendor and customer; the first source that has it wins, vendors are never merged."""
    order = "CASE source WHEN 'app store' THEN 0 WHEN 'play store' THEN 1 WHEN 'logo wall' THEN 2 ELSE 3 END"
    return f"SELECT vendor_key, customer_key, source, claim_id FROM (SELECT vendor_key, {normalized_company(d, 'customer_name')} AS customer_key, source, claim_id, row_number() OVER (PARTITION BY vendor_key, {normalized_company(d, 'customer_name')} ORDER BY {order}, claim_id) AS nth FROM claim) WHERE nth = 1"


@query
def resolve_todo(d):
    """Claims whose address is not in the cache yet."""
    return "SELECT DISTINCT c.part FROM claim c LEFT JOIN resolved_cache k ON c.part = k.id WHERE c.domain IS NULL AND k.id IS NULL"


@query
def incumbent_lookup(d):
    """Claims on the domains that were asked for, the surest first; a domain without any was looked up all the same."""
    score = "CASE c.confidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CONFIDENCE.items()) + " ELSE 0 END"
    if d.spark:  # claims are ranked before the join, which then finds them dealt and sorted by domain: a task sorts them once. A domain that is asked n times has each claim n times
        return f"""
SELECT q.domain, c.vendor_name, c.vendor_tier, c.confidence, {score} AS confidence_score, CAST(q.n * (coalesce(c.nth, 1) - 1) + k AS INTEGER) AS nth, c.claim_id IS NOT NULL AS found
FROM (SELECT domain, count(*) AS n FROM asked_domain GROUP BY domain) q
LEFT JOIN (SELECT c.domain, c.vendor_name, c.vendor_tier, c.confidence, c.claim_id, row_number() OVER (PARTITION BY c.domain ORDER BY {score} DESC, c.vendor_name, c.claim_id) AS nth FROM claim c WHERE NOT c.is_client_vendor AND c.domain IS NOT NULL) c ON q.domain = c.domain
LATERAL VIEW explode(sequence(1L, q.n)) _k AS k"""
    return f"""
SELECT q.domain, c.vendor_name, c.vendor_tier, c.confidence, {score} AS confidence_score, CAST(row_number() OVER (PARTITION BY q.domain ORDER BY {score} DESC, c.vendor_name, c.claim_id) AS INTEGER) AS nth, c.claim_id IS NOT NULL AS found
FROM asked_domain q LEFT JOIN (SELECT * FROM claim WHERE NOT is_client_vendor AND domain IS NOT NULL) c ON q.domain = c.domain"""


@query
def incumbent_profile(d):
    """A domain's vendors by tier, the surest first, what is current and former, the surest claim, and what that means for a sale."""
    score = "CASE confidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CONFIDENCE.items()) + " ELSE 0 END"
    # a vendor stands where its surest claim stands; its place among the others decides the order of names
    vendors = f"SELECT domain, vendor_tier, vendor_name, max({score}) AS best, max(CASE WHEN historical THEN 1 ELSE 0 END) AS former FROM claim WHERE domain IS NOT NULL AND NOT is_client_vendor GROUP BY domain, vendor_tier, vendor_name"
    place = "concat(CAST(1000 - best AS {0}), vendor_name)".format("STRING" if d.spark else "VARCHAR")
    stack = lambda tier: d.join(d.filt(d.lists(f"CASE WHEN vendor_tier = '{tier}' THEN vendor_name ELSE '' END", place), "x", "x <> ''"), ", ")
    return f"""
SELECT c.domain, CASE WHEN c.claims > 0 THEN 'evidence_found' ELSE 'no_evidence_in_index' END AS status, c.already_client, c.best_score, v.best_match,
  CASE WHEN v.advocacy <> '' THEN 'displacement' WHEN c.claims > 0 THEN 'adjacent_platform' ELSE 'unknown' END AS motion, coalesce(v.advocacy, '') AS advocacy_vendors, coalesce(v.comms, '') AS comms_vendors, coalesce(v.social, '') AS social_vendors,
  CASE WHEN v.n_advocacy > 1 THEN v.advocacy END AS competing_vendors, coalesce(v.formers, '') AS former_vendors, c.former, c.current_claims
FROM (SELECT domain, {d.count_if('NOT is_client_vendor')} AS claims, {d.count_if('is_client_vendor')} > 0 AS already_client, max(CASE WHEN NOT is_client_vendor THEN {score} ELSE 0 END) AS best_score,
  {d.count_if('historical AND NOT is_client_vendor')} AS former, {d.count_if('NOT historical AND NOT is_client_vendor')} AS current_claims FROM claim WHERE domain IS NOT NULL GROUP BY domain) c
LEFT JOIN (SELECT domain, min_by(vendor_name, {place}) AS best_match, {stack('advocacy')} AS advocacy, {stack('comms')} AS comms, {stack('social')} AS social, {d.count_if("vendor_tier = 'advocacy'")} AS n_advocacy,
  {d.join(d.filt(d.lists("CASE WHEN former = 1 THEN vendor_name ELSE '' END", place), "x", "x <> ''"), ', ')} AS formers FROM ({vendors}) GROUP BY domain) v ON c.domain = v.domain"""


@query
def customers_of(d):
    return "SELECT vendor_key, domain, customer_name, confidence FROM claim WHERE vendor_key = 'v3'"


@query
def claims_by_tier(d):
    return "SELECT vendor_tier, confidence, CAST(count(*) AS BIGINT) AS claims, CAST(count(DISTINCT domain) AS BIGINT) AS domains FROM claim GROUP BY vendor_tier, confidence"


@query
def claims_by_source(d):
    return "SELECT source, CAST(count(*) AS BIGINT) AS claims FROM claim GROUP BY source"


@query
def vendor_counts(d):
    return "SELECT vendor_key, vendor_tier, CAST(count(DISTINCT customer_name) AS BIGINT) AS customers FROM claim GROUP BY vendor_key, vendor_tier"


@query
def multi_vendor(d):
    return "SELECT domain, CAST(count(DISTINCT vendor_key) AS BIGINT) AS vendors FROM claim WHERE domain IS NOT NULL AND NOT is_client_vendor GROUP BY domain HAVING count(DISTINCT vendor_key) > 1"


@query
def competing_vendors(d):
    return "SELECT domain, CAST(count(DISTINCT vendor_key) AS BIGINT) AS vendors FROM claim WHERE domain IS NOT NULL AND NOT is_client_vendor AND vendor_tier = 'advocacy' GROUP BY domain HAVING count(DISTINCT vendor_key) > 1"


@query
def former_customers(d):
    return "SELECT vendor_key, domain, customer_name, confidence FROM claim WHERE historical AND NOT is_client_vendor"


@query
def staleness_months(d):
    """Months of 30.44 days since a claim was last renewed; dormant from 24 on."""
    months = f"CAST(floor(({d.seconds(f'TIMESTAMP {chr(39)}{NOW_ORDERS}{chr(39)}')} - {d.seconds('last_updated')}) / 2630016e0 + 0.5) AS BIGINT)"
    return f"SELECT claim_id, months, months >= 24 AS dormant FROM (SELECT claim_id, {months} AS months FROM claim)"
