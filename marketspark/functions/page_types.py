"""What a page's address, headings, schema.org types and head say of its type. All are fixed values."""

from __future__ import annotations

#: Types of pages, ties going to the one that stands first.
PAGE_TYPES = ("homepage", "service", "pricing", "blog", "faq", "contact", "about", "legal", "career", "support", "testimonial", "unknown")

#: Patterns of addresses with how much they count; of each type the first that fits.
ADDRESSES = {
    "homepage": {r"^https?://[^/]+/?$": 0.9, r"/index\.(html|php|asp)$": 0.8},
    "service": {
        "/service": 0.9, "/product": 0.85, "/feature": 0.7, "/solution": 0.7, "/offering": 0.6, "/seva": 0.9, "/cleaning": 0.85, "/repair": 0.85, "/plumbing": 0.85, "/electrical": 0.85, "/pest-control": 0.85, "/beauty": 0.85, "/salon": 0.85,
        "/interior": 0.85, "/painting": 0.85, "/carpentry": 0.85, "/ac-repair": 0.85, "/appliance-repair": 0.85, "/home-services": 0.85, "/deep-cleaning": 0.85, "/sofa-cleaning": 0.85, "/bathroom-cleaning": 0.85, "/kitchen-cleaning": 0.85,
    },
    "pricing": {"/pric": 0.95, "/cost": 0.85, "/plan": 0.7, "/subscription": 0.7, "/tier": 0.6, "/rate": 0.5, "/mulya": 0.9, "/keemat": 0.85, "/rate-list": 0.9, "/price-list": 0.9, "/service-charge": 0.85},
    "blog": {"/blog": 0.95, "/article": 0.9, "/news": 0.8, "/post": 0.7, "/resource": 0.6, "/press": 0.6, "/samachar": 0.7, "/lekh": 0.6},
    "faq": {"/faq": 0.95, "/question": 0.7, "/answer": 0.6, "/prashn": 0.8, "/uttar": 0.7},
    "contact": {"/contact": 0.95, "/reach": 0.6, "/get-in-touch": 0.8, "/sampark": 0.9},
    "about": {"/about": 0.95, "/company": 0.7, "/team": 0.7, "/story": 0.6, "/mission": 0.6, "/values": 0.5, "/bare": 0.9, "/kahani": 0.8},
    "legal": {"/privacy": 0.9, "/terms": 0.9, "/legal": 0.9, "/policy": 0.7, "/cookie": 0.8, "/gdpr": 0.8, "/gopniyata": 0.85, "/sharten": 0.8},
    "career": {"/career": 0.95, "/job": 0.8, "/hiring": 0.8, "/recruit": 0.7, "/work-with": 0.6, "/naukri": 0.85, "/rozgar": 0.8},
    "support": {"/support": 0.9, "/help": 0.8, "/documentation": 0.7, "/docs": 0.7, "/guide": 0.6, "/sahayata": 0.85, "/madad": 0.8},
    "testimonial": {"/testimonial": 0.95, "/review": 0.8, "/case-study": 0.8, "/success-story": 0.7, "/praise": 0.7, "/feedback": 0.6},
}
#: Patterns of headings (h1 to h3); of each type the one that counts most.
HEADINGS = {
    "service": {
        r"our\s+service": 0.9, r"what\s+we\s+do": 0.85, r"our\s+product": 0.85, r"service\s+offering": 0.8, r"hamari\s+seva": 0.9, r"hum\s+kya\s+karte": 0.85, "sevaaye": 0.85, "sevaen": 0.85, r"services?\s+we\s+offer": 0.9, r"home\s+services?": 0.8,
        r"cleaning\s+services?": 0.85, r"repair\s+services?": 0.85, r"maintenance\s+services?": 0.85, r"plumbing\s+services?": 0.85, r"electrical\s+services?": 0.85, r"pest\s+control": 0.85, r"ac\s+repair": 0.85, r"appliance\s+repair": 0.85,
        r"beauty\s+services?": 0.85, r"salon\s+services?": 0.85, r"interior\s+design": 0.85, r"modular\s+kitchen": 0.85, r"painting\s+services?": 0.85, r"carpentry\s+services?": 0.85,
    },
    "pricing": {"pricing": 0.95, r"our\s+plan": 0.85, r"choose\s+your\s+plan": 0.9, r"subscription\s+plan": 0.85, "mulya": 0.9, "keemat": 0.85, "dam": 0.8, r"rate\s+list": 0.9, r"price\s+list": 0.9, r"service\s+charge": 0.85, r"starting\s+at": 0.8, r"starts\s+from": 0.8, r"ab\s+se": 0.75},
    "blog": {r"latest\s+post": 0.9, r"blog\s+post": 0.95, "article": 0.7, "news": 0.6, "samachar": 0.7, "lekh": 0.6, "vichar": 0.6},
    "faq": {r"frequently\s+asked": 0.95, "question": 0.7, r"aam\s+taur\s+par\s+pooche": 0.85, "prashn": 0.7, "uttar": 0.6},
    "contact": {r"contact\s+us": 0.95, r"get\s+in\s+touch": 0.9, r"reach\s+us": 0.85, r"sampark\s+kare": 0.9, r"humse\s+sampark": 0.85, r"call\s+us": 0.9, r"hamare\s+sampark": 0.85},
    "about": {r"about\s+us": 0.95, r"our\s+story": 0.9, r"our\s+team": 0.85, r"our\s+mission": 0.85, r"hamare\s+bare": 0.9, r"hamari\s+kahani": 0.85, r"hamari\s+team": 0.85, r"hamara\s+mission": 0.85},
    "legal": {r"privacy\s+policy": 0.95, r"terms\s+of\s+service": 0.95, r"terms\s+and\s+conditions": 0.95, "gopniyata": 0.85, "sharten": 0.8},
    "career": {r"join\s+our\s+team": 0.9, "career": 0.9, r"job\s+openings": 0.9, "naukri": 0.85, "rozgar": 0.8, "bharti": 0.8},
    "support": {r"help\s+center": 0.9, r"support\s+center": 0.9, "documentation": 0.8, "sahayata": 0.85, "madad": 0.8},
}
#: Types in JSON-LD, each 0.8.
SCHEMA = {
    "Product": "service", "Service": "service", "Offer": "pricing", "PriceSpecification": "pricing", "BlogPosting": "blog", "Blog": "blog", "Article": "blog", "FAQPage": "faq",
    "ContactPage": "contact", "AboutPage": "about", "WebPage": "unknown", "Organization": "about", "LocalBusiness": "about", "JobPosting": "career",
}
#: A title counts by the patterns of addresses, at this share; og:type article and website.
TITLE_SHARE, OG_TYPES = 0.8, {"article": ("blog", 0.7), "website": ("homepage", 0.5)}
