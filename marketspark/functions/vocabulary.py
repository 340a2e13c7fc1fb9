"""Words, types and patterns that pages are judged by. All are fixed values that results depend on."""

from __future__ import annotations

#: Types of segments; ties go to the one that stands first.
SEGMENT_TYPES = (
    "hero", "navigation", "services", "pricing", "plans", "membership", "about", "faq", "reviews", "blog", "contact", "cities",
    "coverage", "features", "legal", "gallery", "footer", "unknown",
)

#: What speaks for a type in headings, labels and texts, in lower case.
SEGMENT_WORDS = {
    "hero": ["welcome", "hero", "banner", "tagline", "get started", "start free", "try for free", "sign up", "book now", "request demo", "watch demo", "swagat", "aapka swagat", "abhi shuru karein", "demo lein"],
    "navigation": ["menu", "navigation", "nav", "sitemap", "breadcrumb", "skip to", "main menu"],
    "services": ["service", "what we do", "offering", "solution", "product", "feature", "capability", "expertise", "how it works", "what you get", "our work", "we offer", "seva", "uplabdh", "hamare kaam", "prakriya", "tarike", "sevayein"],
    "pricing": ["price", "pricing", "plan", "subscription", "cost", "rate", "package", "tier", "per month", "per year", "billed annually", "free trial", "enterprise", "keemat", "kimat", "dainik", "mahina", "varshik", "emi", "kist", "shulk"],
    "plans": ["plan", "our plans", "choose your plan", "compare plans", "plan comparison", "plan options", "pricing plans", "subscription plans", "membership plans"],
    "membership": ["membership", "become a member", "member benefits", "join", "sign up", "register", "create account", "member area", "premium", "pro plan", "business plan"],
    "about": ["about", "our story", "who we are", "our mission", "our vision", "our team", "leadership", "founded", "values", "culture", "history", "why us"],
    "reviews": ["review", "testimonial", "rating", "what our customers say", "customer story", "success story", "trustpilot", "g2", "capterra", "client feedback", "customer review", "star", "rated", "recommended", "justdial", "sulekha", "urbanclap", "google reviews"],
    "faq": ["faq", "frequently asked", "question", "answer", "help", "how do i", "what is", "can i", "is there", "do you", "sawaal", "jawaab", "sawaal-jawaab", "madad"],
    "blog": ["blog", "article", "news", "post", "latest", "insight", "resource", "update", "press", "media"],
    "cities": ["city", "cities", "service area", "location", "where we serve", "coverage area", "regions", "states", "zip code", "postal code", "available in", "nationwide", "local", "pincode", "district", "taluka", "mandal", "tehsil", "nagar", "sector"],
    "coverage": ["coverage", "service area", "network", "supported region", "availability", "operating area", "footprint", "reach"],
    "features": ["feature", "capability", "specification", "what's included", "includes", "included", "comparison", "compare", "vs", "feature matrix", "feature list"],
    "legal": ["legal", "privacy", "terms", "policy", "cookie policy", "gdpr", "ccpa", "disclaimer", "license", "agreement"],
    "gallery": ["gallery", "portfolio", "showcase", "our work", "projects", "case study", "screenshot", "photo", "image gallery", "video gallery", "media gallery"],
    "contact": ["contact", "get in touch", "reach us", "reach out", "send message", "write to us", "email us", "call us", "phone", "address", "location", "find us", "sampark", "call karein", "sampark karein"],
    "footer": ["copyright", "©", "all rights reserved", "privacy policy", "terms of service", "terms & conditions", "sitemap", "cookie policy"],
}

#: What a tag, a role or a schema.org type says of a segment.
TAG_TYPES = {"header": "hero", "nav": "navigation", "footer": "footer", "aside": "unknown"}
ROLE_TYPES = {"banner": "hero", "navigation": "navigation", "main": "unknown", "contentinfo": "footer", "complementary": "unknown", "search": "unknown", "form": "contact", "region": "unknown"}
SCHEMA_TYPES = {
    "FAQPage": "faq", "Question": "faq", "Answer": "faq", "Product": "services", "Service": "services", "ServiceList": "services", "ItemList": "services",
    "Offer": "pricing", "AggregateOffer": "pricing", "PriceSpecification": "pricing", "BlogPosting": "blog", "Article": "blog", "NewsArticle": "blog",
    "ContactPage": "contact", "AboutPage": "about", "Organization": "about", "LocalBusiness": "about", "WPFooter": "footer", "WPHeader": "hero", "SiteNavigationElement": "navigation",
}

#: A price in a text, a text that starts as a question (word boundaries hold for letters of any language).
PRICE_TEXT = r"(?i)[$€£₹¥]\s*[0-9,]+|rs\.?\s*[0-9,]+|[0-9,]+\s*(?:usd|eur|gbp|inr|jpy)(?:$|[^\p{L}\p{N}_])|[0-9,]+/-"
FAQ_START = r"(?i)^\s*(how|what|why|when|where|who|can|do|is|are|will|does|kaise|kya|kyun|kab|kahan|kaun)(?:$|[^\p{L}\p{N}_])"
