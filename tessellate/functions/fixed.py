"""Rules, word lists, bands and weights that decide results. Plain data, in one place."""

# URL sections in the order in which they are tried, each with the patterns of its paths.
SECTIONS = [
    ("blog", [r"^/blog(/|\z)", r"^/posts?(/|\z)", r"^/articles?(/|\z)", r"^/insights?(/|\z)"]),
    ("case_study", [r"^/(customers?|case-?stud(y|ies)|(customer|success|client)-?stories|clients?|testimonials?)(/|\z)", r"case-stud", r"customer-stories", r"^/(projects|project-profiles)(/|\z)"]),
    ("recipe", [r"^/recipes?(/|\z)"]),
    ("resource", [r"^/(resources?|library|content|learn|hub|tips|tips-and-ideas)(/|\z)"]),
    ("guide_ebook", [r"^/(guides?|ebooks?|whitepapers?|reports?|playbooks?|templates?|checklists?|toolkits?)(/|\z)"]),
    ("news_press", [r"^/(news|press|newsroom|press-releases?|media|company-news|news-events)(/|\z)", r"^/about/news(/|\z)", r"/(news-releases?|press-releases?)(/|\z)", r"(^|/)newsroom(/|\z)"]),
    ("event_webinar", [r"^/(events?|webinars?|conferences?|summit|workshops?|demos?)(/|\z)"]),
    ("podcast_video", [r"^/(podcasts?|videos?|watch|episodes?|shows?)(/|\z)"]),
    ("careers", [r"^/(careers?|jobs?|job|openings?|opportunities|hiring|join-us)(/|\z)"]),
    ("culture", [r"^/(life-at|life|culture|our-people|people|team|employees?|our-story|diversity|dei|belonging|values)(/|\z)", r"/life-at-", r"/employee-(story|stories|spotlight)"]),
    ("about", [r"^/(about|about-us|company|who-we-are|mission|leadership|investors)(/|\z)", r"^/about-[a-z0-9-]+(/|\z)"]),
    ("docs_support", [r"^/(docs?|documentation|developers?|api|support|help|help-center|customer-service|knowledge-?base|kb|faqs?|community|forums?|drivers?|downloads?|glossary)(/|\z)"]),
    ("locations", [r"^/(locations?|stores|store-locator|our-locations|find-a-store|branches)(/|\z)"]),
    ("product", [r"^/(product|products|platform|features?|capabilities|technologies|gpu|hardware|software)(/|\z)"]),
    ("solutions", [r"^/(solutions?|use-?cases?|industries|verticals|for|services?)(/|\z)"]),
    ("pricing", [r"^/(pricing|plans|packages)(/|\z)"]),
    ("partner_integration", [r"^/(partners?|integrations?|marketplace|apps?|ecosystem)(/|\z)"]),
    ("legal", [r"^/(legal|privacy|terms|cookie|gdpr|dpa|security|trust|compliance|accessibility|sitemap|terms-and-conditions|terms-conditions)(/|\z)", r"privacy-policy", r"terms-of", r"^/privacy-[a-z0-9-]+(/|\z)"]),
    ("author_tag_taxonomy", [r"^/(author|authors|tag|tags|category|categories|topic|topics|archive)(/|\z)", r"/(tag|category|author)/"]),
    ("contact_demo", [r"^/(contact|contact-us|demo|instant-demo|request-demo|tour|platform-tour|product-tour|get-started|book|schedule|signup|sign-up|register|login|log-in|trial|lp)(/|\z)"]),
    ("home", [r"^/\z"]),
]

# Section words of other languages, tried after the English ones.
FOREIGN_SECTIONS = [
    ("news_press", [r"^/(aktuelles|nachrichten|neuigkeiten|presse|pressemitteilungen|actualites|communiques-de-presse|salle-de-presse|nieuws|persberichten|nyheter|pressmeddelanden|noticias|prensa|actualidad|sala-de-prensa|notizie|novita|comunicati-stampa|comunicazione|aktuality|novinky|tiskove-zpravy|uutiset|uutishuone|ajankohtaista)(/|\z)", r"/(pressemitteilungen|persberichten|pressmeddelanden|comunicati-stampa|tiskove-zpravy)(/|\z)"]),
    ("blog", [r"^/blogg(/|\z)"]),
    ("event_webinar", [r"^/(veranstaltungen|evenements|evenementen|evenemang|eventos|eventi|webinare|webinaires|seminare|tapahtumat)(/|\z)"]),
    ("case_study", [r"^/(referenzen|referenties|temoignages|casos-de-exito)(/|\z)"]),
    ("careers", [r"^/(karriere|karriar|carrieres|carriere|vacatures|werken-bij|lediga-jobb|jobb|empleo|ofertas-de-empleo|offres-emploi|emploi|trabaja-con-nosotros|carreras|lavora-con-noi|kariera|volna-mista|stellenangebote|tyopaikat|avoimet-tyopaikat)(/|\z)"]),
    ("about", [r"^/(ueber-uns|uber-uns|unternehmen|a-propos|qui-sommes-nous|entreprise|over-ons|om-oss|om-foretaget|sobre-nosotros|quienes-somos|empresa|chi-siamo|azienda|o-nas|o-spolecnosti|yritys|tietoa-meista)(/|\z)"]),
    ("legal", [r"^/(datenschutz|impressum|agb|rechtliches|mentions-legales|confidentialite|cgu|cgv|algemene-voorwaarden|privacybeleid|privacyverklaring|integritetspolicy|anvandarvillkor|villkor|aviso-legal|privacidad|politica-de-privacidad|condiciones|informativa-privacy|note-legali|ochrana-osobnich-udaju|obchodni-podminky|zasady-ochrany-osobnich-udaju|tietosuoja|kayttoehdot)(/|\z)"]),
    ("contact_demo", [r"^/(kontakt|contacto|contatti|contactez-nous|yhteystiedot)(/|\z)"]),
    ("product", [r"^/(produkte|produits|producten|produkter|productos|prodotti|produkty|tuotteet)(/|\z)"]),
    ("solutions", [r"^/(loesungen|losungen|dienstleistungen|leistungen|diensten|tjanster|servicios|servizi|sluzby|palvelut|losningar|soluciones|soluzioni|oplossingen|reseni|ratkaisut|branchen)(/|\z)"]),
    ("docs_support", [r"^/(hilfe|kennisbank|utbildningar|aide|ayuda|assistenza|napoveda|tuki)(/|\z)"]),
    ("pricing", [r"^/(preise|tarifs|prijzen|priser|precios|prezzi|cenik|hinnat)(/|\z)"]),
    ("locations", [r"^/(standorte|filialen|niederlassungen|magasiner|vestigingen|sedi|oficinas)(/|\z)"]),
]

# Shop inventory, tried last.
CATALOG_SECTIONS = [("catalog_listing", [r"^/(store|shops?|collections?|properties|flights|colleges|scholarships|bewertung(en)?|catalogue?|listings|inventory)(/|\z)", r"^/p/."])]

# Dated paths, filler pages, and pages nobody would share.
DATED_POST = r"^/[0-9]{4}/[0-9]{2}/[0-9]{2}/."
DATED_ARCHIVE = r"^/[0-9]{4}(/[0-9]{2}){1,2}/?\z"
CRUFT = r"^/copy-of-|header-footer"
LOREM = "lorem ipsum dolor consectetur adipisci adipiscing eiusmod incididunt repudiandae expedita voluptas voluptatem quisquam perspiciatis accusantium doloremque laudantium".split()
NOT_SHARED = r"(?i)/(terms|terms-and-conditions|terms-conditions|rules|sweepstakes|giveaway|contest|legal|privacy|disclaimer|sponsors?-?(and-)?exhibitors?|exhibitors?|floor-?plan|agenda|registration|register|thank-?you|confirmation|unsubscribe|search|page/[0-9]+)(/|\z)"
SHAREABLE = ["blog", "case_study", "recipe", "resource", "guide_ebook", "news_press", "event_webinar", "podcast_video", "culture"]

# ISO 639-1 codes, and those that are also ordinary path words.
LANGUAGES = "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
LOOKALIKES = "it no is as be or in to so an my me do go id os ai pi la se st na ha hi".split()

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk com.au net.au org.au edu.au gov.au com.br com.mx com.ar co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr co.nz net.nz "
    "org.nz govt.nz co.za org.za com.sg com.my com.hk com.tw com.cn net.cn org.cn gov.cn co.in net.in org.in gen.in com.tr com.pl com.es com.pt com.co com.pe com.ve com.ec "
    "com.uy co.il com.ua com.vn com.ph co.th com.sa com.eg com.ng com.gh co.ke com.pk com.bd com.ru net.ru org.ru"
).split()

# User agents of AI crawlers, with what they do; the agents a common one-click rule blocks.
AGENTS = [
    ("GPTBot", "train"), ("OAI-SearchBot", "search"), ("ChatGPT-User", "user-fetch"), ("ClaudeBot", "train"), ("Claude-User", "user-fetch"),
    ("Claude-SearchBot", "search"), ("anthropic-ai", "train"), ("Google-Extended", "train"), ("Googlebot", "search"), ("Bingbot", "search"),
    ("PerplexityBot", "search"), ("Perplexity-User", "user-fetch"), ("Applebot", "search"), ("Applebot-Extended", "train"), ("Amazonbot", "search"),
    ("meta-externalagent", "train"), ("Meta-ExternalFetcher", "user-fetch"), ("CCBot", "train"), ("Bytespider", "train"), ("cohere-ai", "train"),
    ("YouBot", "search"), ("DuckAssistBot", "search"), ("Diffbot", "train"), ("ImagesiftBot", "train"), ("CloudflareBrowserRenderingCrawler", "render"),
]
ONE_CLICK_BLOCKLIST = ["amazonbot", "applebot-extended", "bytespider", "ccbot", "claudebot", "cloudflarebrowserrenderingcrawler", "google-extended", "gptbot", "meta-externalagent"]
ACCESS_WEIGHTS = {"search": 3, "user-fetch": 3, "train": 1, "render": 1}

# Piecewise-linear bands (value, points).
VOLUME = [(0, 0), (10, 3), (30, 10), (100, 18), (400, 26), (1500, 33), (5000, 40)]
DIVERSITY = [(0, 0), (1, 4), (2, 9), (3, 14), (4, 19), (5, 24), (6, 27), (8, 30)]
SHARE = [(0, 0), (10, 4), (25, 10), (45, 16), (65, 23), (85, 30)]
RECENCY = [(0, -8), (10, -4), (25, 0), (50, 4), (80, 8)]
CULTURE = [(0, 0), (1, 8), (3, 16), (10, 24), (30, 30)]
CAREERS_DEPTH = [(0, 0), (1, 5), (5, 10), (20, 15)]
STORIES = [(0, 0), (1, 8), (3, 15)]
HOME_SCHEMA = [(0, 0), (1, 4), (3, 8), (6, 12), (10, 15)]
POSTING_RATE = [(0, 0), (3, 2.5), (6, 7.5), (10, 13), (18, 20), (25, 25)]
DECISION_MAKERS = [(0, 0), (0.6, 2), (1.2, 4.5), (2.3, 8), (4, 12), (6, 15)]
CADENCE = [(0, 0), (20, 1.5), (39, 3), (71, 5.5), (100, 8), (200, 10)]
OPEN_REQS = [(0, 0), (3, 8), (10, 16), (30, 24), (100, 31), (400, 35)]
VELOCITY = [(0, 0), (2, 6), (8, 12), (25, 17), (80, 20)]
SITE_SIZE = [(0, 0), (200, 4), (1000, 8), (5000, 12), (20000, 15)]
VOICE_DIVERSITY = [(0, 0), (1, 5), (3, 14), (6, 24), (12, 32), (24, 35)]
VOICE_SPREAD = [(0, 0), (30, 6), (50, 12), (70, 18), (92, 20)]
VOICE_CULTURE = [(0, 0), (1, 4), (3, 9), (10, 14), (30, 15)]
VOICE_CAREERS = [(0, 0), (1, 2), (5, 5), (20, 7)]
VOICE_AUTHORS = [(0, 0), (1, 3), (10, 6), (50, 8)]
SHARE_WEIGHTS = {"og_image": 35, "og_title": 15, "og_description": 15, "share_affordance": 30, "twitter_card": 3, "canonical": 2}
CATEGORY_WEIGHTS = {"content_supply": 0.30, "shareability": 0.25, "employee_culture": 0.25, "ai_discoverability": 0.20}
GRADES = [("A", 85), ("B", 70), ("C", 55), ("D", 40), ("F", 0)]
LEAST_POOL, LEAST_INDEXED = 30, 25

# Share controls in a page.
SHARE_CONTROLS = [
    ("x_twitter", r"(?i)(twitter\.com/intent/tweet|x\.com/intent/(tweet|post))"),
    ("linkedin", r"(?i)linkedin\.com/(sharing/share-offsite|shareArticle|cws/share)"),
    ("facebook", r"(?i)facebook\.com/(sharer|dialog/share)"),
    ("reddit", r"(?i)reddit\.com/submit"),
    ("email", r"(?i)mailto:\?[^\x22\x27]*(subject|body)="),
    ("generic", r"(?i)(class|data-[a-z-]*)\s*=\s*[\x22\x27][^\x22\x27]*\b(share|social-share|addtoany|sharethis)\b"),
]

# Job-board hosts (token in group 1), tokens that name no board, titles that buy, words of roles.
JOB_BOARDS = [
    ("greenhouse", r"(?i)(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"),
    ("lever", r"(?i)jobs\.lever\.co/([a-z0-9_-]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([a-z0-9_-]+)"),
    ("smartrecruiters", r"(?i)careers\.smartrecruiters\.com/([a-z0-9_-]+)"),
    ("workable", r"(?i)apply\.workable\.com/([a-z0-9_-]+)"),
    ("eightfold", r"(?i)([a-z0-9-]+)\.eightfold\.ai"),
    ("phenom", r"(?i)([a-z0-9-]+)\.phenompeople\.com"),
    ("icims", r"(?i)([a-z0-9-]+)\.icims\.com"),
    ("jobvite", r"(?i)jobs\.jobvite\.com/([a-z0-9_-]+)"),
]
WORKDAY = r"(?i)([a-z0-9-]+)\.(wd[0-9]+)\.myworkdayjobs\.com/([a-z0-9_-]+)?"
BOARD_NOISE = "embed job_board www jobs careers search api v1 boards app static cdn assets vs-errors errors help docs support go try my".split()
BUYER_TITLES = [
    ("employer_brand", r"(?i)\b(employer|talent)[\s-]?brand"),
    ("internal_comms", r"(?i)\b(internal|employee)[\s-]?comm(unication)?s?\b"),
    ("corporate_comms", r"(?i)\b(corporate|company)[\s-]?comm(unication)?s?\b"),
    ("social_media", r"(?i)\bsocial[\s-]?media\b"),
    ("employee_advocacy", r"(?i)\bemployee[\s-]?advocacy\b"),
    ("comms_leadership", r"(?i)\b(head|director|vp|vice president|chief)\b[^,|]{0,40}\bcommunications?\b"),
]
ROLE_WORDS = r"(?i)\b(engineer|developer|manager|director|head|vp|vice president|chief|lead|architect|designer|analyst|specialist|coordinator|recruiter|scientist|consultant|strategist|marketer|controller|counsel|administrator|representative|executive|associate|partner|officer|intern)\b"
NOT_ROLES = r"(?i)\b(cookie|privacy|terms|policy|blog|resources?|pricing|contact|about us|log ?in|sign ?up|newsletter|subscribe|demo|webinar|customers?|press)\b"
STORY_PATHS = r"(?i)(life-at|life_at|employee-(story|stories|spotlight|profile)|meet-the-team|our-people|team-member|culture|day-in-the-life|why-i-joined|inside-)"

# Words that do not identify a company.
GENERIC_NAME_WORDS = "group groupe inc corp corporation company limited ltd llc plc holdings international global services service solutions technology technologies systems partners associates consulting digital agency web media the and".split()
COMPANY_SUFFIXES = r"\b(inc|llc|ltd|limited|gmbh|ag|sa|nv|bv|plc|corp|corporation|co|company|group|holding|holdings|international|global|the)\b"
STEM_SUFFIXES = r"\b(inc|llc|ltd|limited|gmbh|ag|nv|bv|plc|corp|corporation|group|holdings?)\b"
CANDIDATE_TLDS = ".com .de .fr .nl .co.uk .io .be .se .es .it .co .net .dk .ch .at .fi .no .ie .com.au .ca".split()
BUNDLE_NOISE = "cb app apps ios android appstore mobile engage prod production release member intune client v2 new store".split()
NON_CUSTOMER_HOSTS = "apple.com apps.apple.com itunes.apple.com play.google.com google.com facebook.com linkedin.com twitter.com x.com instagram.com youtube.com wordpress.com wixsite.com squarespace.com godaddy.com github.io sites.google.com notion.site example.com localhost".split()
PARKED = r"(?i)(domain\s+(is\s+)?for\s+sale|buy\s+this\s+domain|parked\s+(free\s+)?at|godaddy|sedo|namecheap\s+parking|under\s+construction)"
CONFIDENCE = {"confirmed": 90, "probable": 70, "possible": 40}

# Visible bylines, and types of structured data that are articles.
BYLINE = r"(?is)<[^>]+(?:rel=[\x22\x27]author[\x22\x27]|itemprop=[\x22\x27]author[\x22\x27]|class=[\x22\x27][^\x22\x27]*\b(?:author|byline|post-author)\b[^\x22\x27]*[\x22\x27])[^>]*>(.{0,160}?)</[a-z]+>"
ARTICLE_TYPES = r"(?i)^(Article|BlogPosting|NewsArticle|TechArticle|Report)\z"

# Names of platforms, which stand on vendors' pages without being customers; words that are no company; words of sentences.
PLATFORMS = (
    "salesforce,sharepoint,microsoft,microsoft teams,teams,slack,google,gmail,google workspace,workday,okta,zoom,outlook,office 365,microsoft 365,sap successfactors,servicenow platform,"
    "instagram,youtube,facebook,linkedin,twitter,x,tiktok,pinterest,threads,whatsapp,snapchat,g2,capterra,trustpilot,trustradius,gartner,forrester,getapp,softwareadvice,"
    "apple,android,app store,google play,aws,azure,sso,saml,okta verify,screencloud,copilot,microsoft copilot,sap,oracle netsuite,dropbox,box,onedrive,jira,confluence"
).split(",")
NO_COMPANY = (
    "logo,logos,client,clients,customer,customers,partner,partners,brand,brands,star,stars,5 stars,4 stars,rating,review,reviews,quote,avatar,photo,image,icon,"
    "home,about,about us,pricing,blog,contact,contact us,careers,login,sign in,sign up,menu,search,close,next,previous,arrow,read more,learn more,case study,case studies,"
    "customer story,customer stories,success story,success stories,testimonial,testimonials,employee advocacy,employee communication,social media,internal communications,intranet,"
    "privacy policy,terms,cookie,cookies,demo,book a demo,free trial,get started,download,faq,vip,header,footer,banner,hero,background,placeholder,thumbnail,video,webinar,"
    "ebook,guide,report,whitepaper,blog post,news,press,events,event,resources,product,solutions,platform,company,team,people,culture,story,stories,overview,features"
).split(",")
SENTENCE_START = r"(?i)^(how|why|what|when|where|the story|creating|building|making|meet|introducing|inside|discover|see how|watch|read|learn|case|customer|a |an )\b"
DANGLING_END = r"(?i)\s(with|through|and|to|for|by|at|in|of|on|from|using|helped|enables?|enabled|boosted|leveraged|drove|drives|improves?|improved|increases?|increased|builds?|built|turns?|turned|gets?|got|wins?|won)\z"
HAS_VERB = r"(?i)\b(helped|enables?|enabled|boosted|leveraged|drove|drives|improves?|improved|increases?|increased|builds?|built|turns?|turned|achieves?|achieved|reduces?|reduced|scales?|scaled|launches?|launched|delivers?|delivered|creates?|created|uses?|used|chose|chooses|partners?|partnered)\b"
PERSON = r"(\b[A-Z]\.\s)|(\s[A-Z]\.?\z)|(\b(van|von|der|den|del|della|bin|ibn)\s)"
RATING = r"^[0-9]+(\.[0-9]+)?\s*(stars?|%)?\z"
NAME_TAIL = r"(?i)\s*[-–|:]?\s*(customer ?story|customer ?stories|case ?study|case ?studies|success ?story|testimonial|employee app|employee communication app|employee communication|communication app|mitarbeiter[- ]?app|intranet|app)\s*\z"
NAME_HEAD = r"(?i)^(case study|customer story|success story|how)\s*[:–-]?\s*"
LOGO_WORDS = r"(?i)\b(logo|logos|logotype|wordmark|icon|image|img|photo|picture|header|footer|white|black|colour|color|rgb|cmyk|transparent|final|copy|scaled|full|small|large|new|old|v[0-9]+|logo[0-9]+|png|svg|jpe?g|webp)\b"
# Story addresses of vendors, and what their last segments are cut of.
STORY_FOLDER = r"(?i)^(case-stud(y|ies)|customer-stor(y|ies)|success-stor(y|ies)|customers?|clients?|portfolio|testimonials?)\z"
STORY_NONE = r"(?i)^(page|p|[0-9]+|index|all|category|tag|feed|amp)\z"
STORY_HEAD = r"(?i)^(case-study|customer-story|success-story|how)-"
STORY_TAIL = r"(?i)-(employee-advocacy|employee-influencers|social-selling|case-study|customer-story|success-story|personal-brands|advocacy|intranet|internal-comms|enterprise|story|testimonial)(-.*)?\z"
