"""Invented people, places and addresses as Column expressions, and what counts as reserved for examples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import rng

FIRST = [["Amara", "Beatriz", "Chidi", "Dolores", "Elif", "Freya", "Greta", "Hana", "Ines", "Jaya", "Katya", "Leila", "Maren", "Noor", "Odile", "Priya"],
         ["Anton", "Bruno", "Cyril", "Dmitri", "Emre", "Farid", "Goran", "Hugo", "Ivo", "Jonas", "Kofi", "Luca", "Mateo", "Nils", "Oscar", "Pavel"]]
LAST = ["Abara", "Brandt", "Cisneros", "Duarte", "Eriksen", "Fontaine", "Galvez", "Hoffer", "Ibarra", "Jensen", "Kowal", "Lindgren", "Moreau", "Novak", "Okafor", "Pereira", "Quispe", "Rossi", "Santos", "Tanaka", "Ueda", "Varga", "Wolff", "Zidane"]
CITIES = ["Arequipa", "Bergen", "Cork", "Dakar", "Essen", "Fukuoka", "Graz", "Hobart", "Izmir", "Jaipur", "Kumasi", "Lyon", "Malmo", "Natal", "Oran", "Porto"]
COUNTRIES = ["Austria", "Brazil", "Chile", "Denmark", "Estonia", "Finland", "Ghana", "Hungary", "Iceland", "Japan", "Kenya", "Latvia", "Malta", "Norway", "Oman", "Peru"]
STREETS = ["Alder Way", "Birch Row", "Canal Street", "Dock Lane", "Elm Court", "Fern Road", "Grove Avenue", "Hill Street"]
FIRMS = ["Aurum", "Borealis", "Cobalt", "Delphin", "Ember", "Fathom", "Granite", "Harbor", "Isthmus", "Juniper"]
ENDINGS = ["Works", "Labs", "Group", "Partners", "Systems", "Foods", "Logistics", "Media"]
JOBS = ["Archivist", "Baker", "Cartographer", "Data Engineer", "Electrician", "Florist", "Geologist", "Nurse", "Optician", "Planner", "Surveyor", "Teacher"]
DOMAINS = ["example.com", "example.net", "example.org", "mail.test", "corp.example"]
AREAS = [202, 212, 303, 312, 404, 415, 503, 512, 602, 617, 702, 713, 808, 816, 901, 919]
NETS = ["192.0.2", "198.51.100", "203.0.113"]
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()
ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿšžÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝŠŽ", "aaaaaaaeeeeeiiiiioooooouuuuuncyyszAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCYSZ")
SIZES = {"city": len(CITIES), "country": len(COUNTRIES), "job": len(JOBS), "company": len(FIRMS) * len(ENDINGS), "first_name": sum(map(len, FIRST)), "last_name": len(LAST), "name": sum(map(len, FIRST)) * len(LAST), "phone": len(AREAS) * 100, "ipv4": len(NETS) * 254, "bool": 2}


def domain(kind: str) -> list | None:
    """All values of a finite type, None if it has no end or isn't listed."""
    lists = {
        "city": lambda: CITIES, "country": lambda: COUNTRIES, "job": lambda: JOBS, "last_name": lambda: LAST, "first_name": lambda: FIRST[0] + FIRST[1], "bool": lambda: [False, True],
        "company": lambda: [f"{a} {b}" for a in FIRMS for b in ENDINGS], "name": lambda: [f"{a} {b}" for a in FIRST[0] + FIRST[1] for b in LAST],
        "phone": lambda: [f"+1-{a}-555-01{i:02d}" for a in AREAS for i in range(100)], "ipv4": lambda: [f"{n}.{i}" for n in NETS for i in range(1, 255)],
    }
    return lists[kind]() if kind in lists else None


def local_part(name: Column) -> Column:
    """The e-mail local part of a name: accents folded, words joined by dots, only letters, digits and ._- left."""
    folded = F.lower(F.translate(name, *ACCENTS))
    dotted = F.array_join(F.filter(F.split(F.regexp_replace(folded, r"\.", " "), r"\s+"), lambda x: x != ""), ".")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(dotted, r"[^a-z0-9._-]", ""), r"\.{2,}", "."), r"^\.+|\.+$", "")
    return F.when(clean == "", "user").otherwise(clean)


def draw(kind: str, key: str, row: Column, *, sentences: int = 2, name: Column | None = None) -> Column:
    """One value of a semantic type for each row."""
    p = lambda values, k: rng.pick(values, key, row, k)
    first = lambda: F.when(rng.uniform(key, row, 10) < 0.5, p(FIRST[0], 11)).otherwise(p(FIRST[1], 11))
    full = lambda: F.concat_ws(" ", first(), p(LAST, 12))
    if kind == "email":
        return F.concat(local_part(full() if name is None else F.coalesce(name, full())), F.lit("@"), p(DOMAINS, 13))
    if kind == "text":
        n = max(1, int(sentences))
        out = []
        for s in range(n):
            words = F.transform(F.sequence(F.lit(0), F.lit(4) + rng.index(key, row, 10, 100 + s).cast("int")), lambda i, s=s: F.element_at(F.array(*map(F.lit, LOREM)), (F.pmod(F.xxhash64(F.lit(key), row.cast("long"), F.lit(s), i), F.lit(len(LOREM))) + 1).cast("int")))
            line = F.array_join(words, " ")
            out.append(F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 10_000), F.lit(".")))
        return F.concat_ws(" ", *out)
    return {
        "first_name": first, "last_name": lambda: p(LAST, 12), "name": full, "city": lambda: p(CITIES, 14), "country": lambda: p(COUNTRIES, 15), "job": lambda: p(JOBS, 16),
        "company": lambda: F.concat_ws(" ", p(FIRMS, 17), p(ENDINGS, 18)),
        "address": lambda: F.concat((rng.index(key, row, 998, 19) + 1).cast("string"), F.lit(" "), p(STREETS, 20), F.lit(", "), p(CITIES, 14)),
        "phone": lambda: F.concat(F.lit("+1-"), p(AREAS, 21).cast("string"), F.lit("-555-01"), F.lpad(rng.index(key, row, 100, 22).cast("string"), 2, "0")),
        "url": lambda: F.concat(F.lit("https://"), F.lower(F.concat(p(FIRMS, 17), p(ENDINGS, 18))), F.lit(".example.com")),
        "ipv4": lambda: F.concat_ws(".", p(NETS, 23), (rng.index(key, row, 254, 24) + 1).cast("string")),
    }[kind]()


RESERVED = r"(?i)^[a-z0-9_%+'-]+(\.[a-z0-9_%+'-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)*(example(\.(com|net|org))?|test|invalid|localhost)$"
PHONE = r"^\+1-[2-9]\d{2}-555-01\d{2}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IPV4 = r"^(192\.0\.2|198\.51\.100|203\.0\.113)\.([1-9]|[1-9]\d|1\d\d|2[0-4]\d|25[0-4])$"
