"""Fixed values of the document extraction: headings, word lists and patterns.

All are compared in lower case unless said otherwise.
"""

from __future__ import annotations


def _items(text: str) -> list[str]:
    return [item.strip() for item in text.replace("\n", " ").split(";") if item.strip()]


# Headings.
DESCRIPTION_HEADINGS = _items("""
    course description; course overview; course structure; why does this course matter?; course summary:;
    course overview, content and objectives; course description – the big questions; course description:;
    course background; short description:; course format:; overview:; course objective:; course summary;
    course information:; description
""")
DESCRIPTION_PARTS = _items("rationale; objectives; target audience; objective; prerequisite:; description:")
DESCRIPTION_STOPS = _items("academic objectives; learning outcomes")
GOAL_HEADINGS = _items("""
    course learning objectives; learning outcomes; learning objectives; objectives:; learning goals;
    course objectives; course goals and outcomes; learning objectives:; learning outcomes:; academic objectives;
    course-level learning outcomes; student learning outcomes:; course objectives:; learning outcome:;
    learning outcomes/ objectives; after completing this course you will be able to:;
    learning objectives and outcomes:; learning outcomes: wood mechanics; course learning outcomes:;
    academic objectives:
""")
TOPIC_HEADINGS = _items("""
    schedule of topics; topics; course topics; schedule; schedule of learning topics; course schedule;
    lecture schedule; tentative lecture schedule; tentative schedule; schedule of topics and assessments;
    course contents; course content; lecture topics; lectures; weekly schedule; weekly course schedule;
    course outline; class schedule; class topics; lecture outline; course calendar; weekly topics;
    weekly modules; modules; course modules; units; course units; weekly readings and topics;
    schedule of classes; schedule of lectures; lecture and lab schedule; course and lab schedule;
    topics and schedule; course topics and schedule; learning topics and important dates;
    list of topics to be covered
""")
TOPIC_STOPS = _items("""
    assessment; assessments; communication protocols; academic and learning resources; netiquette expectations;
    universities policies; university policies; academic integrity; assessment of learning;
    assessments of learning; assessment of student learning; assessment methods; assessment schedule;
    breakdown of marks; mark breakdown; grade breakdown; graded activities; grading scheme; grading;
    course grading; course grade; evaluation; evaluations; examinations assignments and grading; examinations;
    assignments; course assignments; learning materials; course materials;
    learning materials and technology requirements; course materials and learning resources;
    course structure & learning materials; learning resources; required materials; required readings;
    recommended readings; textbook; textbooks; course policies; student support; student wellbeing;
    academic accommodations; accessibility; contacts; contact; teaching team; instructional staff; copyright;
    learning objectives; learning outcomes; course learning objectives; course learning outcomes; test schedule
""")
CONTENTS_PAGES = _items("""
    table of contents; syllabus contents; document contents; overview of contents; summary of contents
""")
MATERIAL_HEADINGS = _items("""
    learning materials; course materials; required readings; recommended readings; textbook; textbooks;
    required textbook; required textbooks; course resources; learning resources; materials and resources;
    textbook and references; textbook and readings; course materials and learning resources;
    learning materials and technology requirements; course structure and learning materials;
    course structure & learning materials; course references; supplies needed; optional readings;
    optional textbook; optional textbooks; optional resources; required materials;
    recommended literature sources; recommended literature resources; recommended literature source;
    recommended literature resource; recommended sources; recommended resources;
    textbooks and additional resources; primary textbook; primary textbooks; course textbook; course textbooks;
    required course materials; course readings and materials; what textbook do you need;
    what textbook do you need?
""")
MATERIAL_STOPS = _items("""
    assessment; assessments; assessment of learning; assessments of learning; assessment of student learning;
    assessment methods; assessment schedule; breakdown of marks; mark breakdown; grade breakdown;
    graded activities; grading scheme; grading; course grading; course grade; evaluation; evaluations;
    examinations assignments and grading; examinations, assignments and grading; examinations; assignments;
    course assignments; technology requirements; course policies; university policies; academic integrity;
    academic and learning resources; student support; student wellbeing; academic accommodations; accessibility;
    communication protocols; contacts; contact; teaching team; instructional staff; copyright; course structure;
    learning activities; course structure and learning activities; course objectives; expectations;
    paper discussions; quizzes; participation; project; learning objectives; learning outcomes;
    course learning objectives; course learning outcomes; schedule of topics; topics; course topics; schedule;
    schedule of learning topics; course schedule; lecture schedule; tentative lecture schedule;
    tentative schedule; schedule of topics and assessments; course contents; course content; lecture topics;
    weekly schedule; weekly course schedule; course outline; class schedule; class topics; lecture outline;
    course calendar; weekly topics; weekly modules; modules; course modules; units; course units;
    weekly readings and topics; schedule of classes; schedule of lectures; lecture and lab schedule;
    course and lab schedule; academic conduct; academict misconduct
""")

# Headings of table columns, and the sections that hold topic tables.
TOPIC_PAGE_HEADINGS = [*TOPIC_HEADINGS, "draft course schedule", "tenative lecture schedule"]
TOPIC_PAGE_STOPS = [
    "assessment", "assessments", "assessment of learning", "assessments of learning", "assessment of student learning",
    "assessment methods", "assessment schedule", "breakdown of marks", "mark breakdown", "grade breakdown",
    "graded activities", "grading scheme", "grading", "course grading", "course grade", "evaluation", "evaluations",
    "examinations assignments and grading", "examinations", "assignments", "course assignments", "learning materials",
    "course materials", "learning materials and technology requirements", "course materials and learning resources",
    "course structure & learning materials", "learning resources", "course policies", "university policies",
    "academic integrity", "student support", "student wellbeing", "academic accommodations", "accessibility",
    "communication protocols", "contacts", "contact", "teaching team", "instructional staff", "copyright",
    "course objectives", "learning objectives", "learning outcomes", "course learning objectives",
    "course learning outcomes", "test schedule",
]
TITLE_TABLE_COLUMNS = ["course title"]
ASSESSMENT_NAME_COLUMNS = [
    "item", "assessment", "graded activities", "component", "activity", "assignment", "category", "components", "module",
    "type", "grading component", "evaluations", "learning assessment", "grade component", "graded activities/assignments",
    "winter term I", "winter term II", "exams and problem sets",
]
ASSESSMENT_MARK_COLUMNS = [
    "mark", "percentage", "marks", "weight (%)", "weight", "% of final grade", "total weight", "percentage of final grade",
    "assignment weight", "%", "weighting", "pts (/100)", "percent of final grade", "% final mark", "percent of grade",
    "grade weight",
]
TOPIC_COLUMNS = [
    "topic", "topics", "lecture", "lecture topic", "lecture topics", "lab topic", "lab topics", "class topic",
    "class topics", "course topic", "course topics", "module topics", "weekly topics", "weekly topic", "topic speaker",
    "topic and speaker", "topics and speakers", "speaker topic", "speaker and topic", "topic presenter",
    "topic facilitator", "learning topic", "learning topics", "topics covered", "topic description", "theme",
    "topic covered", "topic of lecture", "module",
]
TITLE_COLUMNS = ["title", "name", "topic name", "topic title", "topics title"]
SCHEDULE_COLUMNS = ["week", "date", "dates", "module", "unit", "lecture"]
MODULE_COLUMNS = ["module", "module name", "course module"]
THEME_COLUMNS = ["theme", "themes"]
IGNORED_COLUMNS = [
    "reading", "readings", "readings deadlines", "readings and deadlines", "deadline", "deadlines", "due date",
    "assessment", "assessments", "activity", "activities", "mark", "marks", "weight", "weight %", "percentage", "%",
    "number", "#", "week", "in-class", "in class", "work",
]
ASSESSMENT_COLUMNS = [
    "item", "mark", "marks", "weight", "due date", "assessment", "assessments", "assignment", "assignments",
]
ITINERARY_COLUMNS = [
    "activity", "activities", "transpo", "transportation", "accoms", "accommodations", "meals", "meals provided",
    "course deliverables", "course deliverables and notes",
]

# Words.
GOAL_VERBS = _items("""
    demonstrate; develop; conduct; describe; understand; outline; diagnose; show; sketch; read; recognize; explain;
    define; make; geocode; produce; utilize; acquire; complete; compare; identify; provide; evaluate; prepare;
    appreciate; know; proficient; efficiently; perform; create; generate; data handling and analyzing; importexport;
    managing; plan; enhance; explore; have a thorough understanding; apply; analyze; interpret; discuss; suggest;
    communicate; give; be able to put; be able to plot; organize; acheive; become familiar; gain a foundation;
    critically engage; gain understanding; gain specific understanding; to understand; to become; select; design;
    calculate; incorporate; working in groups; assess the challenges; propose; contrast the evolution;
    name and describe; integrate; manage large; derive; solve; illustrate; assess; critically evaluate; display;
    participate in inter-governmental; follow the developments; use simpler procedures; give specific examples;
    given particular; for each of these; relate these concepts; thoughtfully reflect on;
    clearly and concisely communicate; summarize; choose; be able to; will be able to; students will be able to
""")
STOP_WORDS = _items("""
    i; me; my; myself; we; our; ours; ourselves; you; you're; you've; you'll; you'd; your; yours; yourself;
    yourselves; he; him; his; himself; she; she's; her; hers; herself; it; it's; its; itself; they; them; their;
    theirs; themselves; what; which; who; whom; this; that; that'll; these; those; am; is; are; was; were; be;
    been; being; have; has; had; having; do; does; did; doing; a; an; the; and; but; if; or; because; as; until;
    while; of; at; by; for; with; about; against; between; into; through; during; before; after; above; below;
    to; from; up; down; in; out; on; off; over; under; again; further; then; once; here; there; when; where; why;
    how; all; any; both; each; few; more; most; other; some; such; no; nor; not; only; own; same; so; than; too;
    very; s; t; can; will; just; don; don't; should; should've; now; d; ll; m; o; re; ve; y; ain; aren; aren't;
    couldn; couldn't; didn; didn't; doesn; doesn't; hadn; hadn't; hasn; hasn't; haven; haven't; isn; isn't; ma;
    mightn; mightn't; mustn; mustn't; needn; needn't; shan; shan't; shouldn; shouldn't; wasn; wasn't; weren;
    weren't; won; won't; wouldn; wouldn't
""")
ASSESSMENT_NOISE = _items("""
    late; penalty; deduct; approximately; student; please; may; passing; it; must; percentage; deadline; their;
    there; will; least; reduced; excellent; fair; good; worth; additional; reduction; your; than; pass
""")
LETTER_GRADES = ["A", "A-", "B", "B-", "C", "C-", "D", "F (Fail)", "F"]  # case matters
TOPIC_SECTION_NOISE = _items("""
    week; weeks; date; dates; day; days; topic; topics; title; name; lecture; lectures; module; modules; unit;
    units; class; classes; session; sessions; reading; readings; required reading; required readings;
    recommended reading; recommended readings; assignment; assignments; deadline; deadlines; due; due date;
    due dates; quiz; quizzes; exam; exams; test; tests; assessment; assessments; activity; activities; lab; labs;
    tutorial; tutorials; workshop; workshops; in-class work; in class work; who; instructor; location; room;
    notes; comments; description; overview
""")
TOPIC_NOISE = _items("""
    no lab; mid term; no class; class canceled; final; tba; getting started; no readings; no assignments; review;
    midterm; none; canceled; quiz 0; quiz 1; quiz 2; quiz 3; quiz 4; quiz 5; quiz 6; assignment; due;
    in-class practice; exam; test; reading; term break; spring break; holiday; thanksgiving; remembrance day;
    labour day; make-up class; make up class; project presentations; case study presentations; no lecture;
    no tutorial; wrap up; quiz unit 1; quiz unit 2; quiz unit 3
""")
MATERIAL_LABELS = _items("""
    required textbook; required textbooks; optional textbook; optional textbooks; optional articles;
    optional article; required readings; required reading; optional reading; optional readings;
    optional text for lectures; optional text for labs; digital resources; course materials;
    other course materials; recommended literature sources; textbook and references;
    required documentary / video content; podcast and audio media; websites and online articles;
    recomended literature sources; learning materials; learning materials and technology requirements; podcast; online articles;
    required and optional readings; video; textbook; primary textbook; primary textbooks; course textbook;
    course textbooks; required course materials; course readings and materials; readings; iclicker;
    suggested reading materials; e-books on r; e-books on choosing and fitting models; other useful books; required equipment
""")
MATERIAL_LINE_NOISE = _items("""
    none; n/a; na; not applicable; supplies needed; technology requirements; technology; course resources;
    learning resources; textbook and readings; recommended readings; optional resources; course website; canvas;
    course structure; learning activities; marks; weight; office hours; week; date; lecture; lab; assignment;
    quiz; quizzes; exam; exams; midterm; final exam; participation;
    additional readings will be provided through canvas;
    additional articles, multimedia resources, case studies, and readings will be provided through canvas modules;
    all updated course information will be available through the canvas course website;
    only registered students will have access to the course materials hosted through canvas;
    students should have access to a computer or tablet capable of accessing canvas;
    there are no mandatory textbook requirements for this course;
    the following are optional textbooks and resources for review;
    students experiencing difficulties with course technologies assignments or course materials are encouraged to contact the teaching team early in the term;
    course materials are intended only for students enrolled in the course and may not be redistributed without permission;
    all materials in this course are the intellectual property of the course instructor or licensed for educational use;
    laptop; mobile device; tablet; paper;
    calculator; wifi; internet; textbooks and additional resources
""")
MATERIAL_KEYWORDS = _items("""
    textbook; edition; readings; reading; slides; canvas; software; arcgis; qgis; calculator; journal articles;
    case studies; documentary; video; podcast; website; portal; articles; article; book
""")
SKIPPED_START, SUGGESTED = "technology requirements", "suggested reading materials"
GENERIC_KEYWORDS = ["canvas", "readings", "reading", "slides"]
INSTRUCTION_PHRASES = _items("""
    students can access; students can purchase; hardcopies are also available; most required readings;
    required readings that are not from; course canvas website; supplementary readings;
    all course materials will be posted; use of canvas; make sure that you can access canvas;
    sure that you can access canvas; problem, please contact; note: to download; to download this book;
    students can read parts of; another good overview; downloaded from; suggested technical requirements;
    course materials are taken directly; you will need a laptop; module 0 on canvas;
    obtain at least one reference book; also need r reference books; access a number of excellent e-books;
    recommendations for e-books; not be required to purchase; readings can all be accessed; slides for each lecture;
    available at canvas; regularly login to your course page; your syllabus, course-lecture slides;
    announcements, assignments; required and supplementary learning materials; learning management system
""")
IGNORED_MATERIALS = _items("""
    none; n/a; na; not applicable; tba; to be announced; see canvas; canvas; canvas site; course website;
    course textbook and readings; software tools;
    additional readings and case studies will be provided through canvas.; through canvas modules.;
    throughout the term in canvas modules.;
    there are no mandatory textbook requirements for this course and all lecture materials will be supplied through canvas.;
    learning materials;
    learning materials and technology requirements; course materials; other course materials; course resources;
    learning resources; materials and resources; textbook and references; textbook and readings;
    required textbook; required textbooks; optional textbook; optional textbooks; required reading;
    required readings; recommended reading; recommended readings; optional reading; optional readings;
    recommended literature sources; recommended literature resources;
    digital resources; online resources; web resources; technology requirements; supplies needed; equipment;
    software; calculator; laptop; tablet; mobile device; internet; wifi; course policies; academic integrity;
    student support; communication protocols; assessment; assessments; assignments; schedule; topics; week; date;
    lecture; lab; tutorial; textbook; textbooks
""")
GENERIC_CANVAS = _items("""
    posted on canvas; available on canvas; provided through canvas; will be posted on canvas;
    will be posted in canvas; canvas modules;
    canvas course website; canvas site; class materials; lecture slides; announcements; assignment descriptions;
    readings, assignments
""")
GENERIC_LITERATURE = _items("""
    copies of some papers; provided on the course canvas; provided on canvas; good starting point;
    comprehensive or complete overview; students are responsible for collecting; recent relevant literature;
    keep an eye on the canvas; available through
""")
CONCRETE_TERMS = _items("""
    article; book; textbook; podcast; video; documentary; portal; database; software; dataset; edition; arcgis;
    qgis; e-flora; national geographic; narwhal
""")
# In order: the first type named by the material, else by its description.
MATERIAL_TYPES = _items("""
    textbook; software; podcast; video; website; article; case study; online resource; digital resource;
    lecture slides; slides; reading; book; movie; calculator; equipment
""")
MONTHS = _items("""
    January; February; March; April; May; June; July; August; September; October; November; December
""")
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_NUMBER = {
    **{name: i + 1 for i, name in enumerate(MONTHS)}, **{name: i + 1 for i, name in enumerate(MONTH_SHORT)}, "Sept": 9,
}

# Patterns, in the part of the syntax Java and RE2 share.
PAGE_NUMBER_TEXT = r"(?i)Page\s+\d+|\d+\s*/\s*\d+|\d+\s+of\s+\d+|^\d+$|^\d+\s+.+$|^-\s*\d+\s*-$"
FILE_NAME_CODE = r"([A-Za-z]{3,4})(?:[-_ ]?[Vv])?[-_ ]*([0-9]{3})(?:[^0-9]|$)"
TEXT_CODE = r"(?:^|[^\p{L}\p{N}_])([A-Z]{3,4} *[0-9]{3}[\p{L}\p{N}_]*)"
WHOLE_CODE = r"^[A-Z]{3,4} *[0-9]{3}[A-Z]?$"
TERM = (
    r"(?i)(Fall[ _]?20[0-9]{2}|Winter[ _]?Term[ _]?[12](?:[^0-9]|$)|20[0-9]{2}[ _]?[WS][ _]?[12](?:[^0-9]|$)"
    r"|Term[ ]?[12][ ]?20[0-9]{2})"
)
TERM_NAMES = [  # first that fits
    (r"(?i)fall|w1|winter[\s_]?term[\s_]?1|term[\s_]?1", "Winter Term 1"),
    (r"(?i)w2|winter[\s_]?term[\s_]?2|term[\s_]?2", "Winter Term 2"),
    (r"(?i)s1|summer[\s_]?term[\s_]?1", "Summer Term 1"),
    (r"(?i)s2|summer[\s_]?term[\s_]?2", "Summer Term 2"),
]
YEAR = r"20[0-9]{2}"
WORD = r"[\p{L}\p{N}_]+"
BULLET = r"^([(]?[0-9]+(?:\.[0-9]+)*[.)]?|[•\-–*¢●]|\([a-zA-Z]\))\s*"
LIST_MARK = r"(?i)^(?:(?:[0-9]+|[ivxlcdm]+)[.)]|[•\-–*¢●])\s*(.*)$"
LONE_MARK = r"(?i)^(?:[0-9]+|[ivxlcdm]+)[.)]\s*$"
SECTION_NUMBER = r"^[0-9]+(?:\.[0-9]+)*[.)]?\s*"
NUMBERED_TITLE = r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+[A-Z][A-Za-z&/ -]+$"
UPPER, LOWER = r"\p{Lu}", r"\p{Ll}"
TITLE_BREAK = r"[\p{Lu}\p{Ll}]\p{Lu}|(?:^|[^\p{Lu}\p{Ll}])\p{Ll}"  # what title case never has
COURSE_LINE = r"^[A-Z]{4}[ ]?[0-9]{3}"
TITLE_LABEL = r"(?:Course [Tt]itle|course Title|Course Name)[:\s]*(.*)$"
AFTER_DASH, BEFORE_COURSE = r"\s*–.*", r"^.+:\s*"  # around the document's own code
TITLE_BEFORE_CODE = r"^.+:\s*[A-Z]{4}\s*[0-9]{3}\s*$"
WEIGHTED = r"([A-Z][\p{L}\p{N}_\s\[\]\-/–():.&@%*=]*?)[:.…\s]*?([0-9]+(?:\.[0-9]+)?)\s*(?:%|points|pts)(?:\s|$)"
WEIGHT_ALONE = r"^([0-9]+(?:\.[0-9]+)?)\s*(?:%|points|pts)$"
BRACKETED = r"^([A-Z][\p{L}\p{N}_\s\[\]\-/–():.&%]*?)\s*\(\s*([0-9]+)%\s*\)\s*$"
MODULE_LINE = r"(?i)^(?:module|week|unit|lecture)\s+(?:[0-9]+|[ivxlcdm]+)[.:–—-]\s*(.+)$"
DATED_LINE = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+[0-9]{1,2}[,:]?\s+(.+)$"
TOPIC_STAFF = r"(?i)\s*\([^)]*(?:dr\.|instructor|ta|teaching assistant|prof|professor|teacher)[^)]*\)\s*$"
TOPIC_LABELS = r"(?i)^week\s+[0-9]+\s*-\s*[0-9]+$|^[a-z]?[0-9]+(?:\.[0-9]+)*[.)]?$"
TOPIC_DEADLINES = r"^quiz unit [0-9]+$|^assignment [0-9]+|(?:^|[^\p{L}\p{N}_])due(?:[^\p{L}\p{N}_]|$)"
# Names, commas and ampersands are one character class: a repeated group would recurse on long lines.
CITATION = (
    r"^[A-Z][A-Za-z'’.-]+(?:[,\s&][A-Za-z'’.,&\s-]*[A-Za-z'’.-])?\s+(?:\([0-9]{4}\)|[0-9]{4})\.\s+.+\.?$"
)
BIBLIOGRAPHY = r"^[A-Z].{0,120},.*(?:\([0-9]{4}\)|(?:^|[^\p{L}\p{N}_])[0-9]{4})\.?\s+.+"
NUMBERED_ITEM = r"^[0-9]{1,2}[.)]\s+(.+)$"
PUBLICATION = (
    r"(?:^|[^\p{L}\p{N}_])(?:(?:19|20)[0-9]{2}|(?i:Springer|CRC|Wiley|Press|Publishing|Editions|journal|proceedings))"
    r"(?:[^\p{L}\p{N}_]|$)"
)
ENDS_WITH_YEAR = r"(?:\([0-9]{4}\)|(?:^|[^\p{L}\p{N}_])[0-9]{4})\.$"
TEXTBOOK_IS = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(the course textbook is|the textbook for this course is|textbook for this course is"
    r"|course textbook is|primary textbook for this course is|required textbook)\s*:?\s*(.+)$"
)
NO_TEXTBOOK = r"no textbook|there is no textbook|no required textbook|no mandatory textbook"
DATE_LINE = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+[0-9]{1,2}(?:[^0-9]|$)"
PUBLISHER_IN_NAME = r"springer|cambridge university press|routledge|university press"

# Patterns of table cells.
CLASS_TIMES = [
    "hours per week", "hours per term", "class time", "room", "monday", "tuesday", "wednesday", "thursday", "friday",
]
ROOM_NUMBER = r"orch\s+[0-9]+"
TOPIC_SIGNALS = (
    r"(?:^|[^\p{L}\p{N}_])(?:module|topic|topics|theme|seminar|lecture topic|weekly topics)(?:[^\p{L}\p{N}_]|$)"
)
MODULE_LABEL = r"(?i)^(?:module|unit|week)\s+(?:[0-9]+|[ivxlcdm]+)$"
_EDGE = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:[^\p{L}\p{N}_]|$)"
NOT_TOPIC_CELLS = [  # of a cell in lower case
    r"^(?:day|week|module|unit)\s*[0-9ivxlcdm/ -]+$", _EDGE % r"[0-9]{1,2}:[0-9]{2}",
    _EDGE % "mon|tue|wed|thu|fri|monday|tuesday|wednesday|thursday|friday|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec",
    _EDGE % (
        "canvas|reading|readings|assignment|assignments|due|quiz|exam|test|prep|slide|slides|http|www|room|location|mark|weight"
    ),
    r"(?:^|[^\p{L}\p{N}_])(?:\([0-9]{4}\)|[0-9]{4})\.",
]
TOPIC_WORD = r"\p{L}{2,}(?:[-‐‑–—]\p{L}{2,})*"
CELL_ADMIN = r"(?i)^(?:time$|(?:note:|(?:midterm|mid term|final exam|exam|quiz)(?:[^\p{L}\p{N}_]|$)))"
CELL_NO_LABS = r"(?i)^no labs?\s*\((.+)\)$"
CELL_LIST_MARK = r"^(?:[0-9]+[.)]|[-•*])\s+"
CELL_MODULE = r"(?i)^module\s+[0-9]+:"
