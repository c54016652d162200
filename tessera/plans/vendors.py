"""Parts as postings of every vendor: the payload in the vendor's own fields, and what its row must hold.

Payloads are Spark SQL expressions over the columns k, name, title2, brand, slug, kind, size,
page, apply and place of a part; expected values are DuckDB expressions over the same. `a`
(an even size) brings the fields that come first, otherwise those that stand in for them do.
"""

from __future__ import annotations

#: Columns of a part that both sides use.
BASE_COLUMNS = (
    "CAST(p_partkey AS STRING) AS k", "p_name AS name", "p_name || ' II' AS title2", "p_brand AS brand", "lower(p_brand) AS slug", "p_type AS kind", "p_size AS size",
    "'https://x.example/' || CAST(p_partkey AS STRING) AS page", "'https://apply.example/' || CAST(p_partkey AS STRING) AS apply",
    "CASE WHEN p_size % 5 = 0 THEN 'Remote - EU' ELSE 'Berlin' END AS place", "p_partkey AS number",
)
BASE = ", ".join(BASE_COLUMNS)


def a(first: str, second: str = "NULL") -> str:
    return f"CASE WHEN size % 2 = 0 THEN {first} ELSE {second} END"


def third(first: str, second: str = "NULL") -> str:
    """Of parts whose size three does not divide."""
    return f"CASE WHEN size % 3 > 0 THEN {first} ELSE {second} END"


HTML, OTHER = "'<p>' || kind || '</p>'", "'<b>other</b>'"
FAR = "(size % 5 = 0)"
SEVENTH = "(size % 7 = 0)"
DAY = "'2026-08-01'"
BOARD = {"company": "brand", "title": "name", "url": "page", "location": "place", "far": FAR, "text": "kind", "posted": DAY, "pay": "NULL"}
ATS = BOARD | {"mission": "'parts'"}
_TEXTS = {"description": a(HTML), "summary": OTHER, "location": a("place"), "city": "place"}
_LISTED = {"id": a("k"), "title": "name", "name": "title2", "url": a("page"), "link": "apply", "posted": a(DAY), "date": "'2026-07-01'"} | _TEXTS
_LISTED_ROW = ATS | {"id": a("k", "name"), "url": a("page", "apply"), "text": a("kind", "'other'"), "posted": a(DAY, "'2026-07-01'")}
_HTML_BOARD = {"id": "k", "title": "name", "company_name": a("brand"), "url": "page", "description": a("kind"), "location": "place", "mission_category": a("'green'")}
_FLAG = "CASE WHEN size % 7 = 0 THEN '{0}True' ELSE '{0}False' END"


def _html_board(name: str) -> tuple[dict, dict]:
    return _HTML_BOARD, BOARD | {"id": "k", "company": a("brand", "'Unknown'"), "mission": a("'green'", f"'{name}'"), "text": a("kind", "name"), "posted": "NULL"}


def line(text: str) -> str:
    return f"chr(10) || {text}"


#: vendor: (payload, expected row)
VENDORS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "greenhouse": (
        {"id": "k", "title": "name", "absolute_url": "page", "updated_at": a(DAY), "first_published": "'2026-07-01'", "content": HTML, "location": "named_struct('name', place)"},
        ATS | {"id": "k", "posted": a(DAY, "'2026-07-01'")},
    ),
    "ashby": (
        {"id": a("k"), "jobUrl": "page", "title": "name", "descriptionHtml": a(HTML), "description": OTHER, "location": a("place"), "locationName": "place", "isRemote": SEVENTH,
         "compensationTierSummary": a("'50k'"), "publishedAt": DAY},
        ATS | {"id": a("k", "page"), "text": a("kind", "'other'"), "far": f"{FAR} OR {SEVENTH}", "pay": a("'50k'")},
    ),
    "workable": (
        {"shortcode": a("k"), "id": "'i' || k", "title": "name", "url": a("page"), "application_url": "apply", "description": a(HTML), "full_description": OTHER,
         "location": f"named_struct('country', {a(repr('Spain'))}, 'city', place)", "remote": SEVENTH, "published": DAY},
        ATS | {"id": a("k", "'i' || k"), "url": a("page", "apply"), "location": a("'Spain'", "place"), "text": a("kind", "'other'"), "far": f"({FAR} AND size % 2 = 1) OR {SEVENTH}"},
    ),
    "recruitee": (
        {"id": a("k"), "slug": "'s' || k", "title": "name", "description": a(HTML), "requirements": OTHER, "careers_url": a("page"), "url": "apply", "location": a("place"), "city": "place",
         "remote": SEVENTH, "salary": a("'60k'"), "published_at": DAY},
        ATS | {"id": a("k", "'s' || k"), "url": a("page", "apply"), "text": a("kind", "'other'"), "far": f"{FAR} OR {SEVENTH}", "pay": a("'60k'")},
    ),
    "personio": (
        {"id": "k", "name": a("name"), "title": "title2", "jobDescriptions": a(HTML), "description": OTHER, "office": a("place"), "subcompany": "place", "tld": a("'com'"), "createdAt": DAY},
        ATS | {"id": "k", "title": a("name", "title2"), "url": f"'https://' || slug || '.jobs.personio.' || {a(repr('com'), repr('de'))} || '/job/' || k", "text": a("kind", "'other'")},
    ),
    "workday": (
        {"title": a("name"), "jobPostingTitle": "title2", "jobDescription": a(HTML), "description": OTHER, "locationsText": a("place"), "location": "place", "_tenant": a("'ten'"),
         "externalPath": "CASE size % 3 WHEN 0 THEN '/job/' || k WHEN 1 THEN 'https://abs.example/' || k END", "bulletFields": a("array('R' || k)"), "_wd_host": a("'wd3'"), "postedOn": DAY},
        ATS | {"id": a("'R' || k", "title2"), "title": a("name", "title2"), "text": a("kind", "'other'"),
               "url": "CASE size % 3 WHEN 0 THEN 'https://' || " + a("'wd3'", "'wd1'") + " || '.myworkdayjobs.com/job/' || k WHEN 1 THEN 'https://abs.example/' || k ELSE 'https://' || "
                      + a("'wd3'", "'wd1'") + " || '.myworkdayjobs.com/' || " + a("'ten'", "slug") + " || '/External' END"},
    ),
    "bamboohr": (_LISTED, _LISTED_ROW),
    "breezy": (_LISTED | {"name": "name", "title": "title2"}, _LISTED_ROW),
    "jazzhr": (_LISTED, _LISTED_ROW),
    "teamtailor": (_LISTED, _LISTED_ROW),
    "lever": (
        {"id": "k", "text": a("name"), "title": "title2", "descriptionPlain": a("'  ' || kind || '  '"), "description": OTHER, "workplaceType": "CASE WHEN size % 7 = 0 THEN 'remote' ELSE 'hybrid' END",
         "country": "'DE'", "categories": f"named_struct('location', place, 'team', {a(repr('Data'))})", "salaryRange": a("'70k'"), "createdAt": "1785566725000", "hostedUrl": a("page"), "applyUrl": "apply"},
        ATS | {"id": "k", "title": a("name", "title2"), "url": a("page", "apply"), "far": SEVENTH, "text": a("kind", "'other'"), "pay": a("'70k'"), "posted": "'2026-08-01T06:45:25+00:00'",
               "location": "'DE, ' || CASE WHEN size % 7 = 0 THEN 'remote' ELSE 'hybrid' END || ', ' || place || " + a("', Data'", "''")},
    ),
    "smartrecruiters": (
        {"list": f"named_struct('id', k, 'name', name, 'releasedDate', {a(DAY)}, 'location', named_struct('fullLocation', {a('place')}, 'city', 'Bonn', 'country', 'DE', 'remote', {SEVENTH}))",
         "detail": third(f"named_struct('postingUrl', {a('page')}, 'applyUrl', apply, 'releasedDate', '2026-07-01', 'jobAd', named_struct('sections', "
                         f"map('a', named_struct('text', {HTML}), 'b', named_struct('text', ' '), 'c', named_struct('text', '<i>more</i>'))))")},
        ATS | {"id": "k", "url": third(a("page", "apply"), "'https://careers.smartrecruiters.com/' || slug || '/' || k"), "location": a("place || ', '", "''") + " || 'Bonn, DE'",
               "far": f"{SEVENTH} OR ({FAR} AND size % 2 = 0)", "text": third("kind || chr(10) || chr(10) || 'more'", "name"), "posted": a(DAY, third("'2026-07-01'"))},
    ),
    "climatebase": (
        {"id": "k", "title": "name", "employer_name": a("brand"), "name_of_employer": "'Other'", "url": a("page"), "locations": "array(place, 'Rome')",
         "remote_preferences": "CASE WHEN size % 7 = 0 THEN array('Remote ok') END", "salary_from": a("'10'"), "salary_to": "'20'", "salary_period": a("'year'"),
         "employer_short_description": "'short'", "sectors": a("array('energy')"), "activation_date": DAY,
         "detail": third(f"named_struct('sanitized_description', {a(HTML)}, 'description', {OTHER}, 'employer_name', CASE WHEN size % 3 = 1 THEN 'Detail' END)")},
        BOARD | {"id": "k", "company": f"CASE WHEN size % 3 = 1 THEN 'Detail' ELSE {a('brand', repr('Other'))} END", "url": a("page", "'https://climatebase.org/job/' || k"),
                 "text": third(a("kind", "'other'"), "'short'"), "location": "place || '; Rome'", "far": f"{FAR} OR {SEVENTH}", "pay": a("'10 – 20 – year'", "'20'"), "mission": a("'energy'", "'climate'")},
    ),
    "80000hours": (
        {"id": "k", "title": "name", "company_name": a("brand"), "description": a(HTML), "description_short": OTHER, "locations": "array(place, 'Rome')",
         "remote": "CASE WHEN size % 7 = 0 THEN 'fully remote' END", "url": "page", "salary": a("'80k'"), "posted_at": DAY},
        BOARD | {"id": "k", "company": a("brand", "'Unknown'"), "mission": "'effective_altruism'", "text": a("kind", "'other'"), "location": "place || '; Rome'", "far": f"{FAR} OR {SEVENTH}", "pay": a("'80k'")},
    ),
    "escapethecity": (
        {"id": a("k"), "slug": "'s' || k", "title": "name", "company_name": a("brand"), "description": a(HTML), "headline": OTHER, "location": "place",
         "remote": "CASE WHEN size % 7 = 0 THEN 'wfh' END", "salary_low": a("'10'"), "salary_max": third("'20'"), "url": "page", "posted_date": a(DAY), "updated_at": "'2026-07-01'"},
        BOARD | {"id": a("k", "'s' || k"), "company": a("brand", "'Unknown'"), "mission": "'impact'", "text": a("kind", "'other'"), "far": f"{FAR} OR {SEVENTH}",
                 "pay": third(a("'10 – 20'", "'20'"), a("'10'")), "posted": a(DAY, "'2026-07-01'")},
    ),
    "techjobsforgood": (
        {"id": "k", "title": "name", "company_name": "brand", "location": "place", "url": a("page"), "card_text": "array('one', 'two')",
         "detail": third(f"named_struct('text', {a('kind')}, 'meta_description', 'meta')")},
        BOARD | {"id": "k", "mission": "'tech_for_good'", "url": a("page", "'https://techjobsforgood.com/jobs/' || k || '/'"), "text": third(a("kind", "'meta'"), "'one' || chr(10) || 'two'"), "posted": "NULL"},
    ),
    "reliefweb": (
        {"id": a("k"), "fields": f"named_struct('id', 'f' || k, 'title', name, 'body-html', {a(HTML)}, 'body', {OTHER}, 'url', page, 'source', "
                                 + third(f"array(named_struct('name', {a('brand')}, 'shortname', 'Short', 'type', 'NGO'))")
                                 + f", 'country', array(named_struct('name', place), named_struct('name', 'Rome')), 'theme', {a('array(named_struct(' + repr('name') + ', ' + repr('Health') + '))')}"
                                 + f", 'career-category', array(named_struct('name', 'Ops')), 'date', named_struct('created', {DAY}))"},
        BOARD | {"id": a("k", "'f' || k"), "company": third(a("brand", "'Short'"), "'ReliefWeb'"), "mission": "'humanitarian'", "location": "place || ', Rome'", "far": "FALSE",
                 "text": a("kind", "'other'") + " || " + a(line("'Themes: Health'"), "''") + " || " + line("'Career categories: Ops'") + " || " + third(line("'Org type: NGO'"), "''")},
    ),
    "html_board": _html_board("html_board"),
    "idealist": _html_board("idealist"),
    "impactpool": _html_board("impactpool"),
    "animaladvocacycareers": _html_board("animaladvocacycareers"),
    "workonclimate": _html_board("workonclimate"),
    "remotive": (
        {"id": "k", "title": "name", "company_name": "brand", "description": HTML, "candidate_required_location": a("' EU '"), "category": "'Eng'", "tags": a("array('x', 'y')"),
         "job_type": third("'full'"), "url": "page", "salary": a("'90k'"), "publication_date": DAY},
        BOARD | {"id": "k", "mission": "'remote'", "location": a("'EU; Eng'", "'Eng'"), "far": "TRUE", "pay": a("'90k'"),
                 "text": "kind || " + a(line("'candidate_required_location: EU'") + " || " + line("'tags: x, y'"), "''") + " || " + third(line("'job_type: full'"), "''")},
    ),
    "arbeitnow": (
        {"slug": a("'s' || k"), "url": "page", "title": "name", "company_name": "brand", "description": HTML, "location": "place", "remote": third(SEVENTH), "tags": a("array('x', 'y')"),
         "job_types": "array('full')", "created_at": DAY},
        BOARD | {"id": a("'s' || k", "page"), "mission": "'eu_jobs'", "far": f"{FAR} OR (size % 3 > 0 AND {SEVENTH})",
                 "text": "kind || " + a(line("'tags: x, y'"), "''") + " || " + line("'job_types: full'") + " || " + third(line(_FLAG.format("remote_flag: ")), "''")},
    ),
    "jobicy": (
        {"id": a("k"), "jobSlug": "'s' || k", "jobTitle": a("name"), "title": "title2", "companyName": a("brand"), "company_name": "'Other'", "jobDescription": a(HTML), "jobExcerpt": OTHER,
         "jobGeo": a("place"), "jobLevel": "'Senior'", "jobIndustry": "array('x', 'y')", "url": "page", "pubDate": DAY},
        BOARD | {"id": a("k", "'s' || k"), "title": a("name", "title2"), "company": a("brand", "'Other'"), "mission": "'remote_emea'", "location": a("place"), "far": "TRUE",
                 "text": a("kind", "'other'") + " || " + a(line("'jobGeo: ' || place"), "''") + " || " + line("'jobLevel: Senior'") + " || " + line("'industry: x, y'")},
    ),
    "himalayas": (
        {"guid": a("'g' || k"), "companySlug": "'acme'", "title": "name", "companyName": "brand", "description": a(HTML), "excerpt": OTHER, "locationRestrictions": a("array('DE', 'FR')"),
         "timezoneRestrictions": "array('1', '2')", "employmentType": "'Full'", "seniority": a("array('Mid')"), "minSalary": a("'10'"), "maxSalary": third("'20'"), "currency": "'EUR'",
         "applicationLink": a("page"), "url": "apply", "pubDate": DAY},
        BOARD | {"id": a("'g' || k", "'acme-' || name"), "mission": "'remote'", "url": a("page", "apply"), "location": a("'DE; FR'"), "far": "TRUE",
                 "pay": third(a("'10–20 EUR'", "'–20 EUR'"), a("'10– EUR'")),
                 "text": a("kind", "'other'") + " || " + a(line("'locationRestrictions: DE; FR'"), "''") + " || " + line("'timezoneRestrictions: 1, 2'") + " || " + line("'employmentType: Full'")
                         + " || " + a(line("'seniority: Mid'"), "''")},
    ),
    "remoteok": (
        {"id": a("k"), "slug": "'s' || k", "position": "name", "company": "brand", "description": HTML, "location": a("' ' || place || ', '"), "tags": "array('x')", "salary_min": a("10"),
         "salary_max": third("20"), "url": a("page"), "apply_url": "apply", "date": a(DAY), "epoch": "'1785'"},
        BOARD | {"id": a("k", "'s' || k"), "mission": "'remote'", "url": a("page", "apply"), "location": a("place"), "far": "TRUE", "posted": a(DAY, "'1785'"),
                 "pay": third(a("'10–20'", "'0–20'"), a("'10–0'")), "text": "kind || " + a(line("'location: ' || place"), "''") + " || " + line("'tags: x'")},
    ),
    "weworkremotely": (
        {"title": "CASE size % 3 WHEN 0 THEN 'Acme: ' || name WHEN 1 THEN name ELSE 'Acme:' END", "link": a("page"), "guid": "'g' || k", "description": HTML, "region": a("'EU'"), "country": "'DE'",
         "skills": a("'sql'"), "type": "'full'", "pubDate": DAY},
        BOARD | {"id": a("page", "'g' || k"), "url": a("page", "'g' || k"), "mission": "'remote'", "company": "CASE WHEN size % 3 = 0 THEN 'Acme' ELSE 'Unknown' END",
                 "title": "CASE WHEN size % 3 = 2 THEN 'Acme:' ELSE name END", "location": a("'EU; DE'", "'DE'"), "far": "TRUE",
                 "text": "kind || " + a(line("'region: EU'"), "''") + " || " + line("'hireable countries: DE'") + " || " + a(line("'skills: sql'"), "''") + " || " + line("'type: full'")},
    ),
    "workingnomads": (
        {"url": "page", "title": "name", "description": HTML, "location": a("place"), "tags": a("'x,y'"), "category_name": "'Eng'", "company_name": "brand", "pub_date": DAY},
        BOARD | {"id": "page", "mission": "'remote'", "location": a("place"), "far": "TRUE",
                 "text": "kind || " + a(line("'location: ' || place") + " || " + line("'tags: x,y'"), "''") + " || " + line("'category: Eng'")},
    ),
    "hn_whoishiring": (
        {"id": "k", "parts": "CASE size % 3 WHEN 0 THEN array('Acme', 'Dev', 'Berlin', 'REMOTE') WHEN 1 THEN array('Acme') END", "text": a("kind"), "first_line": "'L ' || place", "created_at": DAY},
        BOARD | {"id": "k", "mission": "'hn'", "company": "CASE WHEN size % 3 = 2 THEN 'Unknown' ELSE 'Acme' END", "title": "CASE WHEN size % 3 = 0 THEN 'Dev' ELSE 'L ' || place END",
                 "url": "'https://news.ycombinator.com/item?id=' || k", "location": "CASE WHEN size % 3 = 0 THEN 'Berlin | REMOTE' END",
                 "text": a("kind", "CASE WHEN size % 3 = 0 THEN 'Dev' ELSE 'L ' || place END")},
    ),
    "indeed": (
        {"id": a("k"), "job_url": "page", "job_url_direct": a("'https://direct.example/' || k"), "title": "name", "company": a("brand"), "description": HTML, "location": a("place"),
         "is_remote": third(SEVENTH), "job_type": "'full'", "search_country": a("'DE'"), "min_amount": a("'10'"), "max_amount": third("'20'"), "currency": a("'EUR'"), "interval": "'year'", "date_posted": DAY},
        BOARD | {"id": a("k", "page"), "mission": "'jobboard'", "company": a("brand", "'Unknown'"), "url": a("'https://direct.example/' || k", "page"), "location": a("place"),
                 "far": f"size % 3 > 0 AND {SEVENTH}", "pay": third(a("'10–20 EUR year'", "'–20  year'"), a("'10– EUR year'")),
                 "text": "kind || " + a(line("'location: ' || place"), "''") + " || " + third(line(_FLAG.format("is_remote: ")), "''") + " || " + line("'job_type: full'")
                         + " || " + a(line("'searched in: DE'"), "''")},
    ),
}


def payload_sql(vendor: str) -> str:
    """Spark SQL of the payload; what is NULL is left out."""
    return "to_json(named_struct(" + ", ".join(f"'{name}', {value}" for name, value in VENDORS[vendor][0].items()) + "))"


def expected_sql() -> str:
    """DuckDB SQL of all rows."""
    parts = []
    for i, (vendor, (_, row)) in enumerate(VENDORS.items()):
        board = "mission" in row and row["mission"] != "'parts'"
        kind, slug = ("'job_board'", f"'{vendor}'") if board else (f"'{vendor}'", "slug")
        parts.append(
            f"SELECT '{vendor}' AS source, {row['id']} AS source_job_id, {row['company']} AS company_name, {row['mission']} AS mission_category, {kind} AS ats_type, {slug} AS ats_slug, "
            f"{row['title']} AS title, {row['url']} AS url, {row['location']} AS location_text, {row['far']} AS is_remote, CAST({row['pay']} AS VARCHAR) AS salary_text, "
            f"{row['text']} AS description_text, CAST({row['posted']} AS VARCHAR) AS posted_at_hint FROM p WHERE number % {len(VENDORS)} = {i}"
        )
    return f"WITH p AS (SELECT {BASE} FROM part) " + " UNION ALL ".join(parts)
