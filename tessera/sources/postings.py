"""Posting payloads of job boards to one row shape: `from_json` per vendor, then a projection.

Every vendor is a schema and a mapping; the shared shape has thirteen columns. All of it is
column expressions, so payloads stay in the JVM. All vendors together are one scan: each row
is parsed once, by the schema of its own vendor.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_html

COLUMNS = (
    "source", "source_job_id", "company_name", "mission_category", "ats_type", "ats_slug", "title", "url",
    "location_text", "is_remote", "salary_text", "description_text", "posted_at_hint",
)


def some(*values: Column) -> Column:
    """The first that is neither NULL nor empty, or an empty string."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values], F.lit(""))


def or_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def says_remote(*parts: Column, marks: str = "remote|work from home|distributed") -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])).rlike(marks)


def board_remote(*parts: Column) -> Column:
    """Job boards know one mark more."""
    return says_remote(*parts, marks="remote|work from home|distributed|wfh")


def joined(values: Column, by: str = ", ") -> Column:
    return F.coalesce(F.array_join(values, by), F.lit(""))


def lines(first: Column, extras: list[tuple[str, Column]]) -> Column:
    """The text, then `label: value` lines of the values that are there."""
    tail = F.filter(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in extras]), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(F.array_prepend(tail, first), "\n"), r"^\s+|\s+$", "")


def span(low: Column, high: Column, tail: Column | None = None) -> Column:
    """`low–high tail` if either is a number above 0."""
    body = F.concat(some(low), F.lit("–"), some(high), F.concat(F.lit(" "), tail) if tail is not None else F.lit(""))
    known = (F.coalesce(low.try_cast("double"), F.lit(0.0)) > 0) | (F.coalesce(high.try_cast("double"), F.lit(0.0)) > 0)
    return F.when(known, F.trim(body))


def utc_text(millis: Column) -> Column:
    """Milliseconds since the epoch as a time in UTC, whatever the zone of the session."""
    local = F.timestamp_millis(millis).cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _ats(name: str, **fields: Column) -> dict[str, Column]:
    title, text = fields["title"], fields["text"]
    remote = says_remote(title, text, fields.get("location", F.lit("")))
    if "remote" in fields:
        remote = remote | F.coalesce(fields["remote"], F.lit(False))
    return {
        "source": F.lit(name), "source_job_id": some(fields["id"]), "ats_type": F.lit(name), "title": title, "url": fields["url"],
        "location_text": or_null(fields.get("location", F.lit(""))), "is_remote": remote, "salary_text": or_null(fields.get("salary", F.lit(""))),
        "description_text": text if fields.get("plain") else some(text, title), "posted_at_hint": or_null(fields.get("posted", F.lit(""))),
    }


def _board(name: str, mission: str | Column, **fields: Column) -> dict[str, Column]:
    title = fields["title"]
    return {
        "source": F.lit(name), "source_job_id": some(fields["id"]), "company_name": F.coalesce(or_null(fields["company"]), F.lit("Unknown")),
        "mission_category": F.lit(mission) if isinstance(mission, str) else mission, "ats_type": F.lit("job_board"), "ats_slug": F.lit(name),
        "title": F.coalesce(or_null(title), F.lit("(untitled)")), "url": some(fields["url"]), "location_text": or_null(fields.get("location", F.lit(""))),
        "is_remote": fields.get("remote", F.lit(False)), "salary_text": or_null(fields.get("salary", F.lit(""))), "description_text": some(fields["text"], title), "posted_at_hint": or_null(fields.get("posted", F.lit(""))),
    }


def _listed(name: str, title: tuple[str, ...] = ("title", "name")) -> tuple[str, Callable]:
    schema = "id string, title string, name string, url string, link string, description string, summary string, location string, city string, posted string, date string"

    def build(j: Column) -> dict[str, Column]:
        t = some(*[j[c] for c in title])
        return _ats(name, id=some(j["id"], t), title=t, text=strip_html(some(j["description"], j["summary"])), url=some(j["url"], j["link"]), location=some(j["location"], j["city"]), posted=some(j["posted"], j["date"]))

    return schema, build


def _html_board(name: str) -> tuple[str, Callable]:
    schema = "id string, title string, company_name string, url string, description string, location string, mission_category string"

    def build(j: Column) -> dict[str, Column]:
        return _board(name, some(j["mission_category"], F.lit(name)), id=j["id"], title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=some(j["description"]), location=some(j["location"]), remote=board_remote(j["location"], j["title"]))

    return schema, build


def _greenhouse(j: Column) -> dict[str, Column]:
    return _ats("greenhouse", id=j["id"], title=some(j["title"]), text=strip_html(some(j["content"])), plain=True, url=some(j["absolute_url"]), location=some(j["location"]["name"]), posted=some(j["updated_at"], j["first_published"]))


def _ashby(j: Column) -> dict[str, Column]:
    t = some(j["title"])
    return _ats("ashby", id=some(j["id"], j["jobUrl"], t), title=t, text=strip_html(some(j["descriptionHtml"], j["description"])), url=some(j["jobUrl"], j["applyUrl"]), location=some(j["location"], j["locationName"]), remote=j["isRemote"], salary=some(j["compensationTierSummary"]), posted=some(j["publishedAt"]))


def _workable(j: Column) -> dict[str, Column]:
    t = some(j["title"])
    place = some(j["location"]["country"], j["location"]["city"], j["location"]["location_str"])
    return _ats("workable", id=some(j["shortcode"], j["id"], t), title=t, text=strip_html(some(j["description"], j["full_description"])), url=some(j["url"], j["application_url"]), location=place, remote=j["remote"], posted=some(j["published"]))


def _recruitee(j: Column) -> dict[str, Column]:
    t = some(j["title"])
    return _ats("recruitee", id=some(j["id"], j["slug"], t), title=t, text=strip_html(some(j["description"], j["requirements"])), url=some(j["careers_url"], j["url"]), location=some(j["location"], j["city"]), remote=j["remote"], salary=some(j["salary"]), posted=some(j["published_at"]))


def _personio(j: Column) -> dict[str, Column]:
    t = some(j["name"], j["title"])
    jid = some(j["id"], t)
    url = F.concat(F.lit("https://"), F.col("ats_slug"), F.lit(".jobs.personio."), some(j["tld"], F.lit("de")), F.lit("/job/"), jid)
    return _ats("personio", id=jid, title=t, text=strip_html(some(j["jobDescriptions"], j["description"])), url=url, location=some(j["office"], j["subcompany"]), posted=some(j["createdAt"]))


def _workday(j: Column) -> dict[str, Column]:
    t, parts = some(j["title"], j["jobPostingTitle"]), F.split(F.col("ats_slug"), r"\|")
    host = F.concat(F.lit("https://"), some(j["_wd_host"], F.lit("wd1")), F.lit(".myworkdayjobs.com"))
    path = some(j["externalPath"])
    whole = F.concat_ws("/", host, some(j["_tenant"], F.get(parts, F.lit(0))), some(j["_site"], F.get(parts, F.lit(1)), F.lit("External")))
    url = F.when(path.startswith("/"), F.concat(host, path)).when(path != "", path).otherwise(whole)
    return _ats("workday", id=some(F.get(j["bulletFields"], F.lit(0)), t), title=t, text=strip_html(some(j["jobDescription"], j["description"])), url=url, location=some(j["locationsText"], j["location"]), posted=some(j["postedOn"]))


def _lever(j: Column) -> dict[str, Column]:
    t = some(j["text"], j["title"])
    text = some(F.trim(some(j["descriptionPlain"], j["descriptionBodyPlain"])), strip_html(some(j["description"])))
    c = j["categories"]
    place = F.array_join(F.filter(F.array(*[or_null(some(x)) for x in (j["country"], j["workplaceType"], c["location"], c["team"], c["department"])]), lambda x: x.isNotNull()), ", ")
    out = _ats("lever", id=j["id"], title=t, text=text, plain=True, url=some(j["hostedUrl"], j["applyUrl"]), location=place, salary=some(j["salaryRange"]), posted=utc_text(j["createdAt"].try_cast("long")))
    return out | {"is_remote": (F.lower(some(j["workplaceType"])) == "remote") | says_remote(t, text, j["country"])}


def _smartrecruiters(j: Column) -> dict[str, Column]:
    item, detail = j["list"], j["detail"]
    place = F.array_join(F.filter(F.array(*[or_null(some(item["location"][k])) for k in ("fullLocation", "city", "country")]), lambda x: x.isNotNull()), ", ")
    texts = F.filter(F.transform(F.map_values(detail["jobAd"]["sections"]), lambda s: s["text"]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    url = some(detail["postingUrl"], detail["applyUrl"], F.concat(F.lit("https://careers.smartrecruiters.com/"), F.col("ats_slug"), F.lit("/"), some(item["id"])))
    out = _ats("smartrecruiters", id=item["id"], title=some(item["name"]), text=strip_html(joined(texts, "\n\n")), url=url, location=place, posted=some(item["releasedDate"], detail["releasedDate"]))
    return out | {"is_remote": F.coalesce(item["location"]["remote"], F.lit(False)) | says_remote(item["name"], place)}


def _climatebase(j: Column) -> dict[str, Column]:
    place = joined(j["locations"], "; ")
    pay = F.array_join(F.filter(F.array(*[or_null(some(j[k])) for k in ("salary_from", "salary_to", "salary_period")]), lambda x: x.isNotNull()), " – ")
    d = j["detail"]
    text = some(strip_html(some(d["sanitized_description"], d["description"])), j["employer_short_description"])
    return _board("climatebase", F.coalesce(F.get(j["sectors"], F.lit(0)), F.lit("climate")), id=j["id"], title=some(j["title"]), company=some(d["employer_name"], j["employer_name"], j["name_of_employer"]), url=some(j["url"], F.concat(F.lit("https://climatebase.org/job/"), some(j["id"]))), text=text, location=place, remote=board_remote(place, j["title"], joined(j["remote_preferences"], " ")), salary=pay, posted=some(j["activation_date"]))


def _hours(j: Column) -> dict[str, Column]:
    place, text = joined(j["locations"], "; "), strip_html(some(j["description"], j["description_short"]))
    return _board("80000hours", "effective_altruism", id=j["id"], title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=text, location=place, remote=board_remote(place, j["title"], text, j["remote"]), salary=some(j["salary"]), posted=some(j["posted_at"]))


def _escape(j: Column) -> dict[str, Column]:
    text = strip_html(some(j["description"], j["headline"]))
    known = (some(j["salary_low"]) != "") | (some(j["salary_max"]) != "")
    pay = F.when(known, F.regexp_replace(F.concat(some(j["salary_low"]), F.lit(" – "), some(j["salary_max"])), r"^[ –]+|[ –]+$", ""))
    return _board("escapethecity", "impact", id=some(j["id"], j["slug"]), title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=text, location=some(j["location"]), remote=board_remote(j["location"], j["title"], text, j["remote"]), salary=F.coalesce(pay, F.lit("")), posted=some(j["posted_date"], j["updated_at"]))


def _techjobs(j: Column) -> dict[str, Column]:
    text = some(j["detail"]["text"], j["detail"]["meta_description"], joined(j["card_text"], "\n"))
    return _board("techjobsforgood", "tech_for_good", id=j["id"], title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"], F.concat(F.lit("https://techjobsforgood.com/jobs/"), some(j["id"]), F.lit("/"))), text=text, location=some(j["location"]), remote=board_remote(j["location"], j["title"], text))


def _reliefweb(j: Column) -> dict[str, Column]:
    f = j["fields"]
    names = lambda c: joined(F.filter(F.transform(c, lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    org, body = F.get(f["source"], F.lit(0)), strip_html(some(f["body-html"], f["body"]))
    text = lines(body, [("Themes", names(f["theme"])), ("Career categories", names(f["career-category"])), ("Org type", some(org["type"]))])
    return _board("reliefweb", "humanitarian", id=some(j["id"], f["id"]), title=some(f["title"]), company=some(org["name"], org["shortname"], F.lit("ReliefWeb")), url=some(f["url"]), text=text, location=names(f["country"]), remote=board_remote(body, f["title"]), posted=some(f["date"]["created"]))


def _remotive(j: Column) -> dict[str, Column]:
    need = F.trim(some(j["candidate_required_location"]))
    place = F.array_join(F.filter(F.array(or_null(need), or_null(some(j["category"]))), lambda x: x.isNotNull()), "; ")
    text = lines(strip_html(some(j["description"])), [("candidate_required_location", need), ("tags", joined(j["tags"])), ("job_type", some(j["job_type"]))])
    return _board("remotive", "remote", id=j["id"], title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=text, location=place, remote=F.lit(True), salary=some(j["salary"]), posted=some(j["publication_date"]))


def _arbeitnow(j: Column) -> dict[str, Column]:
    flag = F.when(j["remote"].isNotNull(), F.initcap(j["remote"].cast("string")))
    text = lines(strip_html(some(j["description"])), [("tags", joined(j["tags"])), ("job_types", joined(j["job_types"])), ("remote_flag", flag)])
    return _board("arbeitnow", "eu_jobs", id=some(j["slug"], j["url"]), title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=text, location=some(j["location"]), remote=F.coalesce(j["remote"], F.lit(False)) | board_remote(j["location"], j["title"]), posted=some(j["created_at"]))


def _jobicy(j: Column) -> dict[str, Column]:
    text = lines(strip_html(some(j["jobDescription"], j["jobExcerpt"], j["description"])), [("jobGeo", some(j["jobGeo"])), ("jobLevel", some(j["jobLevel"])), ("industry", joined(j["jobIndustry"]))])
    return _board("jobicy", "remote_emea", id=some(j["id"], j["jobSlug"]), title=some(j["jobTitle"], j["title"]), company=some(j["companyName"], j["company_name"]), url=some(j["url"]), text=text, location=some(j["jobGeo"]), remote=F.lit(True), posted=some(j["pubDate"]))


def _himalayas(j: Column) -> dict[str, Column]:
    place = joined(j["locationRestrictions"], "; ")
    text = lines(strip_html(some(j["description"], j["excerpt"])), [("locationRestrictions", place), ("timezoneRestrictions", joined(j["timezoneRestrictions"])), ("employmentType", some(j["employmentType"])), ("seniority", joined(j["seniority"]))])
    made = F.concat(some(j["companySlug"]), F.lit("-"), some(j["title"]))
    return _board("himalayas", "remote", id=some(j["guid"], j["id"], made), title=some(j["title"]), company=some(j["companyName"]), url=some(j["applicationLink"], j["url"]), text=text, location=place, remote=F.lit(True), salary=F.coalesce(span(j["minSalary"], j["maxSalary"], some(j["currency"])), F.lit("")), posted=some(j["pubDate"]))


def _remoteok(j: Column) -> dict[str, Column]:
    place = F.regexp_replace(some(j["location"]), r"^[ ,]+|[ ,]+$", "")
    text = lines(strip_html(some(j["description"])), [("location", place), ("tags", joined(j["tags"]))])
    return _board("remoteok", "remote", id=some(j["id"], j["slug"]), title=some(j["position"]), company=some(j["company"]), url=some(j["url"], j["apply_url"]), text=text, location=place, remote=F.lit(True), salary=F.coalesce(span(F.coalesce(j["salary_min"], F.lit("0")), F.coalesce(j["salary_max"], F.lit("0"))), F.lit("")), posted=some(j["date"], j["epoch"]))


def _weworkremotely(j: Column) -> dict[str, Column]:
    raw, link = F.trim(some(j["title"])), some(j["link"], j["guid"])
    two = F.regexp_extract(raw, r"^([^:]*):\s*(\S.*)$", 2) != ""
    company, title = F.when(two, F.trim(F.regexp_extract(raw, r"^([^:]*):", 1))), F.when(two, F.regexp_extract(raw, r"^[^:]*:\s*(\S.*)$", 1)).otherwise(raw)
    place = F.array_join(F.filter(F.array(*[or_null(some(j[k])) for k in ("region", "state", "country")]), lambda x: x.isNotNull()), "; ")
    text = lines(strip_html(some(j["description"])), [("region", some(j["region"])), ("hireable countries", some(j["country"])), ("state", some(j["state"])), ("skills", some(j["skills"])), ("type", some(j["type"]))])
    return _board("weworkremotely", "remote", id=link, title=title, company=F.coalesce(company, F.lit("")), url=link, text=text, location=place, remote=F.lit(True), posted=some(j["pubDate"]))


def _workingnomads(j: Column) -> dict[str, Column]:
    text = lines(strip_html(some(j["description"])), [("location", some(j["location"])), ("tags", some(j["tags"])), ("category", some(j["category_name"]))])
    return _board("workingnomads", "remote", id=some(j["url"]), title=some(j["title"]), company=some(j["company_name"]), url=some(j["url"]), text=text, location=some(j["location"]), remote=F.lit(True), posted=some(j["pub_date"]))


def _forum(j: Column) -> dict[str, Column]:
    p = j["parts"]
    return _board("hn_whoishiring", "hn", id=j["id"], title=F.coalesce(F.get(p, F.lit(1)), some(j["first_line"])), company=some(F.get(p, F.lit(0))), url=F.concat(F.lit("https://news.ycombinator.com/item?id="), some(j["id"])), text=some(j["text"]), location=F.coalesce(F.array_join(F.slice(p, 3, 3), " | "), F.lit("")), remote=board_remote(j["first_line"], F.substring(some(j["text"]), 1, 500)), posted=some(j["created_at"]))


def _indeed(j: Column) -> dict[str, Column]:
    text = lines(strip_html(some(j["description"])), [("location", some(j["location"])), ("is_remote", F.initcap(j["is_remote"].cast("string"))), ("job_type", some(j["job_type"])), ("searched in", some(j["search_country"]))])
    pay = span(j["min_amount"], j["max_amount"], F.concat_ws(" ", some(j["currency"]), some(j["interval"])))
    return _board("indeed", "jobboard", id=some(j["id"], j["job_url"]), title=some(j["title"]), company=some(j["company"]), url=some(j["job_url_direct"], j["job_url"]), text=text, location=some(j["location"]), remote=F.coalesce(j["is_remote"], F.lit(False)), salary=F.coalesce(pay, F.lit("")), posted=some(j["date_posted"]))


_NAMES = "array<struct<name:string>>"
#: vendor: (schema of the payload, projection)
VENDORS: dict[str, tuple[str, Callable]] = {
    "greenhouse": ("id string, title string, absolute_url string, updated_at string, first_published string, content string, location struct<name:string>", _greenhouse),
    "ashby": ("id string, title string, jobUrl string, applyUrl string, descriptionHtml string, description string, location string, locationName string, isRemote boolean, compensationTierSummary string, publishedAt string", _ashby),
    "workable": ("id string, shortcode string, title string, url string, application_url string, description string, full_description string, location struct<country:string,city:string,location_str:string>, remote boolean, published string", _workable),
    "recruitee": ("id string, slug string, title string, description string, requirements string, careers_url string, url string, location string, city string, remote boolean, salary string, published_at string", _recruitee),
    "personio": ("id string, name string, title string, jobDescriptions string, description string, office string, subcompany string, tld string, createdAt string", _personio),
    "workday": ("title string, jobPostingTitle string, jobDescription string, description string, locationsText string, location string, _tenant string, _site string, _wd_host string, externalPath string, bulletFields array<string>, postedOn string", _workday),
    "bamboohr": _listed("bamboohr"),
    "breezy": _listed("breezy", ("name",)),
    "jazzhr": _listed("jazzhr"),
    "teamtailor": _listed("teamtailor"),
    "lever": ("id string, text string, title string, descriptionPlain string, descriptionBodyPlain string, description string, workplaceType string, country string, salaryRange string, createdAt string, hostedUrl string, applyUrl string, categories struct<location:string,team:string,department:string>", _lever),
    "smartrecruiters": ("list struct<id:string,name:string,releasedDate:string,location:struct<fullLocation:string,city:string,country:string,remote:boolean>>, detail struct<postingUrl:string,applyUrl:string,releasedDate:string,jobAd:struct<sections:map<string,struct<text:string>>>>", _smartrecruiters),
    "climatebase": ("id string, title string, employer_name string, name_of_employer string, url string, locations array<string>, remote_preferences array<string>, salary_from string, salary_to string, salary_period string, employer_short_description string, sectors array<string>, activation_date string, detail struct<sanitized_description:string,description:string,employer_name:string>", _climatebase),
    "80000hours": ("id string, title string, company_name string, description string, description_short string, locations array<string>, remote string, url string, salary string, posted_at string", _hours),
    "escapethecity": ("id string, slug string, title string, company_name string, description string, headline string, location string, remote string, salary_low string, salary_max string, url string, posted_date string, updated_at string", _escape),
    "techjobsforgood": ("id string, title string, company_name string, location string, url string, card_text array<string>, detail struct<text:string,meta_description:string>", _techjobs),
    "reliefweb": (f"id string, fields struct<id:string,title:string,`body-html`:string,body:string,url:string,source:array<struct<name:string,shortname:string,type:string>>,country:{_NAMES},theme:{_NAMES},`career-category`:{_NAMES},date:struct<created:string>>", _reliefweb),
    "html_board": _html_board("html_board"),
    "idealist": _html_board("idealist"),
    "impactpool": _html_board("impactpool"),
    "animaladvocacycareers": _html_board("animaladvocacycareers"),
    "workonclimate": _html_board("workonclimate"),
    "remotive": ("id string, title string, company_name string, description string, candidate_required_location string, category string, tags array<string>, job_type string, url string, salary string, publication_date string", _remotive),
    "arbeitnow": ("slug string, title string, company_name string, description string, location string, remote boolean, tags array<string>, job_types array<string>, url string, created_at string", _arbeitnow),
    "jobicy": ("id string, jobSlug string, jobTitle string, title string, companyName string, company_name string, jobDescription string, jobExcerpt string, description string, jobGeo string, jobLevel string, jobIndustry array<string>, url string, pubDate string", _jobicy),
    "himalayas": ("guid string, id string, companySlug string, title string, companyName string, description string, excerpt string, locationRestrictions array<string>, timezoneRestrictions array<string>, employmentType string, seniority array<string>, minSalary string, maxSalary string, currency string, applicationLink string, url string, pubDate string", _himalayas),
    "remoteok": ("id string, slug string, position string, company string, description string, location string, tags array<string>, salary_min string, salary_max string, url string, apply_url string, date string, epoch string", _remoteok),
    "weworkremotely": ("title string, link string, guid string, description string, region string, country string, state string, skills string, type string, pubDate string", _weworkremotely),
    "workingnomads": ("url string, title string, description string, location string, tags string, category_name string, company_name string, pub_date string", _workingnomads),
    "hn_whoishiring": ("id string, parts array<string>, text string, first_line string, created_at string", _forum),
    "indeed": ("id string, job_url string, job_url_direct string, title string, company string, description string, location string, is_remote boolean, job_type string, search_country string, min_amount string, max_amount string, currency string, interval string, date_posted string", _indeed),
}


def _row(vendor: str, payload: str) -> Column:
    """struct of the thirteen columns of one payload, which is parsed once."""
    schema, build = VENDORS[vendor]

    def shaped(j: Column) -> Column:
        given = {c: F.col(c) for c in ("company_name", "mission_category", "ats_slug")} | build(j)
        return F.struct(*[given[c].alias(c) for c in COLUMNS])

    return F.transform(F.array(F.from_json(payload, schema)), shaped)[0]


@lru_cache(maxsize=None)
def _rows(vendors: tuple[str, ...], vendor_col: str | None, payload: str, application: str) -> Column:
    """The row by vendor. An expression of thousands of nodes, so an application builds it once."""
    if vendor_col is None:
        return _row(vendors[0], payload)
    return reduce(lambda rows, v: rows.when(F.col(vendor_col) == v, _row(v, payload)), vendors, F)


def normalize(payloads: DataFrame, vendor: str, payload: str = "payload") -> DataFrame:
    """payloads (payload, company_name, mission_category, ats_slug) of one vendor to the thirteen columns."""
    row = _rows((vendor,), None, payload, payloads.sparkSession.sparkContext.applicationId)
    return payloads.select(F.inline(F.array(row)))


def normalize_all(payloads: DataFrame, vendor_col: str = "vendor", payload: str = "payload") -> DataFrame:
    """The rows of all known vendors in one pass."""
    chosen = _rows(tuple(VENDORS), vendor_col, payload, payloads.sparkSession.sparkContext.applicationId)
    return payloads.filter(F.col(vendor_col).isin(*VENDORS)).select(F.inline(F.array(chosen)))
