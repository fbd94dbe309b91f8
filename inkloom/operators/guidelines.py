"""Reporting guidelines: which studies each one is for, and what a report must then say."""

from __future__ import annotations

from inkloom.operators.rules import Rule

# The vocabulary of study types and the checklist items that results are defined by. All ignore case.
RCT = r"randomized\s+controlled\s+trial|randomised\s+controlled\s+trial|\bRCT\b|randomly\s+assigned"
REVIEW = r"systematic\s+review|meta-?analysis|\bPRISMA\b"
OBSERVATIONAL = r"\bcohort\b|case-?control|case\s+series|cross-?sectional|observational"
ANIMAL = r"\bmice\b|\brats\b|zebrafish|animal\s+(?:model|study)|rodents?\b"
PREDICTION = r"prediction\s+model|prognostic\s+model|risk\s+(?:score|model|calculator)|predict(?:ive|ion)?\s+(?:algorithm|model)|machine\s+learning\s+(?:to\s+)?predict|classifier\s+to\s+predict"
VALIDATED = r"pre-?validated|previously\s+(?:externally\s+)?validated|deployment\s+of\s+(?:a|an|the)\s+(?:pre-?validated|published|existing)"
DIAGNOSTIC = r"diagnostic\s+accuracy|sensitivity\s+and\s+specificity|reference\s+standard|gold\s+standard\s+(?:test|comparison)|index\s+test"
PROTOCOL = (
    r"protocol\s+(?:paper|article)|this\s+(?:study\s+)?protocol|we\s+(?:present|describe|report)\s+(?:the\s+)?(?:study\s+)?protocol|"
    r"protocol\s+for\s+the\s+(?:planned|upcoming|ongoing)\s+trial|\bSPIRIT\b|the\s+trial\s+protocol|herein,?\s+we\s+describe\s+the\s+protocol"
)
CASE = r"case\s+report|single\s+case|we\s+report\s+a\s+(?:case|patient)"
QUALITATIVE = r"qualitative\s+(?:study|research|interview)|semi-?structured\s+interviews?|focus\s+groups?|thematic\s+analysis|ethnograph"
ECONOMIC = r"cost[- ]effectiveness|economic\s+evaluation|QALY|incremental\s+cost|ICER\b|cost[- ]utility"
IMPROVEMENT = r"quality\s+improvement|PDSA|plan[- ]do[- ]study[- ]act|improvement\s+(?:initiative|project|intervention)"
QPCR = r"qPCR|real[- ]time\s+PCR|quantitative\s+PCR|RT-?qPCR|reverse\s+transcription\s+PCR"
AI_TRIAL = r"\bAI\b|artificial\s+intelligence|machine\s+learning|deep\s+learning|\balgorithm\b"
#: (family, patterns that must all be found, patterns of which none may be, items (pattern, name)).
GUIDELINES = (
    ("CONSORT", (RCT,), (), (
        (r"consort|participant\s+flow|flow\s+diagram", "flow diagram"), (r"\bNCT\d+|trial\s+registration|clinicaltrials\.gov|registered", "trial registration"),
        (r"random(?:ization|ly|ized)|allocat", "randomization method"), (r"blind(?:ed|ing)?|mask(?:ed|ing)?", "blinding"),
        (r"sample\s+size|power\s+(?:calculation|analysis)|a\s+priori", "sample-size justification"))),
    ("CONSORT-AI", (RCT, AI_TRIAL), (), (
        (r"(?:input|image|text|signal)\s+(?:data|variables?|features?)\s+(?:were|are|used)|preprocess(?:ing|ed)", "algorithm input specification"),
        (r"human[- ](?:AI|machine)\s+interaction|clinician\s+(?:overrid|interaction|in\s+the\s+loop)|operational\s+integration", "human-AI interaction"),
        (r"performance\s+(?:monitor|degrad|drift)|external\s+(?:validation|data\s+set)|update[ds]?\s+(?:the\s+)?model|retrain", "performance monitoring / external validation"))),
    ("SPIRIT", (PROTOCOL,), (), (
        (r"\bNCT\d+|clinicaltrials\.gov|registered|registration", "prospective registration"), (r"eligibility\s+criteria|inclusion\s+criteria|exclusion\s+criteria", "eligibility criteria"),
        (r"primary\s+outcome|co-?primary|secondary\s+outcomes?", "outcome definitions"), (r"ethics\s+approval|IRB|institutional\s+review|ethical\s+(?:committee|clearance)", "ethics approval"))),
    ("PRISMA", (REVIEW,), (), (
        (r"PROSPERO|registered|protocol", "protocol registration (PROSPERO)"),
        (r"search(?:ed)?\s+(?:the|in|across)|database(?:s)?\s+search|PubMed|Scopus|Web\s+of\s+Science|Embase|Cochrane", "search strategy"),
        (r"risk\s+of\s+bias|ROB|Newcastle|NOS|QUADAS|GRADE|Cochrane", "risk-of-bias assessment"), (r"flow\s+diagram|PRISMA\s+flow|study\s+selection|screening|excluded", "PRISMA flow diagram"))),
    ("STROBE", (OBSERVATIONAL,), (RCT, REVIEW), (
        (r"(?:design|type)\s+of\s+study|study\s+design|cohort\s+study|case[- ]control\s+study|cross[- ]sectional\s+study", "study design stated in title/abstract"),
        (r"(?:flow|numbers?)\s+at\s+each\s+stage|excluded\s+\d+|refused|non-?response\s+rate|response\s+rate|of\s+whom\s+\d+|enrolled\s+\d+.{0,80}analy[sz]ed\s+\d+", "participant flow with counts"),
        (r"confound(?:ers?|ing)|adjust(?:ed|ing)\s+for|multivariable|regression\s+(?:model|analysis)|covariates?", "confounding adjustment"),
        (r"missing\s+data|incomplete\s+data|non-?response|imputation|complete-?case", "missing-data handling"), (r"funding|financial\s+support|grant\s+(?:number|support)", "funding statement"))),
    ("STARD", (DIAGNOSTIC,), (), (
        (r"2\s*x\s*2|cross-?tab|contingency\s+table|true\s+positive|TP\s*/?\s*FP", "2x2 contingency table"), (r"sensitivity.{0,60}specificity|specificity.{0,60}sensitivity", "sensitivity AND specificity with CIs"),
        (r"blind(?:ed|ing)?|independent(?:ly)?\s+read|without\s+knowledge\s+of", "blinded test interpretation"), (r"indeterminate|uninterpretable|equivocal|failed\s+(?:test|result)", "indeterminate results"))),
    ("TRIPOD", (PREDICTION,), (VALIDATED,), (
        (r"training.{0,40}(?:and|/)\s*.{0,10}(?:test|validation)|split\s+into.{0,40}(?:train|development)|cross-?validation|held[- ]out", "development/validation separation"),
        (r"AUROC|AUC|c-?statistic|discrimination|calibration\s+(?:plot|slope|intercept)|Brier|Hosmer[- ]Lemeshow", "discrimination and calibration"),
        (r"events?\s+per\s+variable|EPV|sample\s+size\s+(?:calculation|justification|requirement)|events\s+per\s+candidate", "events-per-variable / sample-size reasoning"),
        (r"coefficients?|odds\s+ratios?\s+with|full\s+model|equation|predictor\s+weights?|supplementary.{0,40}model", "full model specification"),
        (r"external\s+validation|validation\s+(?:cohort|dataset|set)|independent\s+(?:cohort|dataset)", "external validation (or its absence stated)"))),
    ("ARRIVE 2.0", (ANIMAL,), (), (
        (r"IACUC|ethics\s+(?:approval|committee)|animal\s+(?:care|welfare)|ARRIVE", "ethics approval (IACUC/ARRIVE)"), (r"random(?:ization|ly|ized)", "randomization"),
        (r"blind(?:ed|ing)?|mask(?:ed|ing)?", "blinding"), (r"sample\s+size|power\s+(?:calculation|analysis)", "sample-size justification"))),
    ("CARE", (CASE,), (), (
        (r"informed\s+consent|written\s+consent|consent\s+(?:was|form)|patient\s+consent", "patient consent"), (r"de-?identif|anonymi[sz]|initials\s+of|pseudonym", "de-identification"),
        (r"timeline|fig\.?\s*1|figure\s+1|course\s+of\s+(?:the\s+)?(?:illness|treatment)", "clinical timeline"))),
    ("SRQR/COREQ", (QUALITATIVE,), (), (
        (r"researcher\s+(?:positionality|reflexivity|characteristics)|we\s+\(?(?:both|all|the\s+team)\)?\s+(?:are|were)|insider\s+research|reflexiv", "researcher reflexivity"),
        (r"theoretical\s+framework|grounded\s+theory|phenomenolog|narrative\s+analysis|framework\s+analysis", "theoretical framework"),
        (r"saturation|no\s+(?:new\s+)?(?:themes?\s+(?:were|emerged)|further\s+(?:codes?|themes?))", "data saturation"),
        (r"coding\s+(?:process|scheme)|open\s+coding|axial\s+coding|double[- ]coding|inter-?coder|codebook", "coding process"))),
    ("CHEERS 2022", (ECONOMIC,), (), (
        (r"perspective\s+(?:of|taken|adopted)|societal\s+perspective|healthcare\s+(?:payer|provider)\s+perspective|patient\s+perspective", "analysis perspective"),
        (r"time\s+horizon|horizon\s+of|lifetime\s+horizon", "time horizon"), (r"discoun(?:t|ted|t\s+rate)|3\s*%\s+discount|annual\s+discount", "discount rate"),
        (r"ICER|incremental\s+cost[- ]effectiveness\s+ratio|net\s+monetary\s+benefit|cost\s+per\s+QALY", "incremental analysis (ICER/NMB)"),
        (r"probabilistic\s+sensitivity|one[- ]way\s+sensitivity|tornado|scenario\s+analysis|uncertainty\s+analysis", "uncertainty analysis"))),
    ("SQUIRE 2.0", (IMPROVEMENT,), (), (
        (r"baseline\s+(?:data|measures?|performance)|pre[- ]intervention|before\s+(?:the\s+)?intervention", "baseline measurement"),
        (r"run\s+chart|control\s+chart|statistical\s+process\s+control|Shewhart|interrupted\s+time\s+series", "time-series analysis of the intervention"),
        (r"contextual\s+(?:factor|element)|local\s+context|balancing\s+measures?|unintended\s+consequences", "context / balancing measures"))),
    ("MIQE", (QPCR,), (), (
        (r"primer\s+(?:sequences?|forward|reverse)|5\s*[-′]\s*[ACGT]{6,}|supplementary.{0,30}primers?", "primer sequences"),
        (r"housekeep(?:ing)?\s+genes?|reference\s+genes?|β-?actin|GAPDH|18S\s+rRNA", "reference gene(s) named"),
        (r"efficiency\s+(?:of|was|=\s*\d{2,3}\s*%)|\d{2,3}\s*%?\s+efficiency|standard\s+curve", "PCR efficiency / standard curve"),
        (r"2\s*[-δ∆]{1,2}\s*C[Tt]|δδCt|delta\s+delta\s+Ct|calibrator", "quantification method (ΔΔCt or absolute)"))),
    ("PRISMA-ScR", (REVIEW, r"scoping\s+review"), (), (
        (r"research\s+question|review\s+question|objectives?\s+of\s+(?:the\s+)?review", "stated review question"), (r"charting|data[- ]charting|extraction\s+form", "data-charting process"),
        (r"PROSPERO|OSF|registered|protocol", "protocol availability"))),
    ("PRISMA-NMA", (REVIEW, r"network\s+meta|multiple[- ]treatment\s+comparison"), (), (
        (r"network\s+(?:geometry|plot|diagram)", "network geometry"), (r"inconsisten|transitivity|node[- ]split", "consistency assessment"), (r"SUCRA|P-?score|rank(?:ing|ed|ings?)|probabilit", "treatment ranking"))),
    ("PRISMA-IPD", (REVIEW, r"individual\s+(?:participant|patient)\s+data|\bIPD\b"), (), (
        (r"sought|obtained|requested\s+(?:the\s+)?(?:IPD|data)", "IPD sought/obtained"), (r"two[- ]stage|one[- ]stage|staged\s+approach", "IPD synthesis method"))),
    ("PRISMA-DTA", (DIAGNOSTIC, REVIEW), (), (
        (r"2\s*x\s*2|contingency|true\s+positive", "2x2 data per study"), (r"hierarch|bivariate|SROC|summary\s+ROC", "pooled accuracy model"))),
    ("PRISMA-SearchAI", (REVIEW, r"automated\s+(?:text|screen)|machine\s+learning\s+(?:in|for)\s+(?:screen|study\s+selection)|text\s+mining\s+screen"), (), (
        (r"sensitivity\s+of\s+(?:the\s+)?(?:automated|screen)|precision\s+of\s+(?:the\s+)?(?:automated|screen)", "tool performance reported"),
        (r"manual\s+screen|human\s+(?:review|screen)|dual\s+screen", "manual verification"))),
    ("PRISMA-TIE", (REVIEW, r"aimed\s+to\s+(?:induce|improve)|improving\s+the\s+(?:conduct|reporting)"), (), (
        (r"aimed\s+to|objective\s+was\s+to\s+(?:improve|induce)", "aim to induce change"), (r"barriers?|facilitators?|behavio(?:u)?ral\s+change", "change process"))),
    ("MOOSE", (REVIEW, r"observational\s+stud(?:ies|y)|meta-?analysis\s+of\s+(?:cohort|case-?control)"), (), (
        (r"Newcastle|NOS\b|Downs\s+and\s+Black|quality\s+(?:assessment|score)", "study quality assessment"), (r"publication\s+bias|funnel\s+plot|Egger", "publication bias"))),
    ("STROBE-GWAS", (OBSERVATIONAL, r"genome-?wide|\bGWAS\b|single[- ]nucleotide\s+polymorphism|\bSNP\b"), (RCT, REVIEW), (
        (r"genome-?wide\s+significant|p\s*<\s*5\s*[x×]\s*10|\b5e-?08\b", "significance threshold"), (r"replication\s+(?:cohort|sample|set)|independent\s+replication", "replication sample"),
        (r"population\s+stratificat|principal\s+components?|genomic\s+control", "population stratification"))),
    ("STROBE-ME", (OBSERVATIONAL, r"molecular\s+epidemiolog|biomarker\s+exposure|laboratory\s+assay"), (RCT, REVIEW), (
        (r"laboratory\s+(?:methods|procedures)|assay\s+(?:protocol|details)", "laboratory methods"), (r"quality\s+control|CV\s*%|coefficient\s+of\s+variation|duplicate\s+samples", "assay quality control"))),
    ("STREGA", (OBSERVATIONAL, r"heritab|familial\s+aggregation|segregation\s+analysis|genetic\s+epidemiolog"), (RCT, REVIEW), (
        (r"population\s+stratificat|ancestry\s+adjust|principal\s+components?", "ancestry adjustment"), (r"Hardy[- ]Weinberg|\bHWE\b", "Hardy-Weinberg reporting"))),
    ("RECORD", (OBSERVATIONAL, r"routine\s+(?:health|care|administrative)\s+data|electronic\s+health\s+records?|\bEHR\b|registry\s+data|claims\s+data"), (RCT, REVIEW), (
        (r"linkage|record\s+linkage|data[- ]linkage", "data linkage"), (r"coding\s+algorithms?|ICD|phenotype\s+definition|validation\s+of\s+(?:the\s+)?(?:coded|routine)", "code/phenotype validation"),
        (r"missing\s+data|completeness\s+of\s+(?:the\s+)?data", "missing-data handling"))),
    ("CLAIM", (r"diagnostic\s+(?:accuracy|algorithm)\s+(?:claims?|stud)|lab-?developed\s+test|laboratory-?developed",), (), (
        (r"\bCLAIM\b|checklist", "CLAIM checklist cited"), (r"analytical\s+(?:validity|performance)|clinical\s+validity", "analytical/clinical validity"))),
    ("REMARK", (r"tumor\s+marker|cancer\s+biomarker|prognostic\s+(?:marker|biomarker)|\bREMARK\b",), (), (
        (r"cut-?\s*(?:point|off)|pre-?specified\s+threshold|continuous\s+per\s+", "marker cut-point"), (r"C-?index|concordance|hazard\s+ratio|relative\s+risk", "marker effect size"),
        (r"validation\s+(?:set|cohort)|split\s+sample|bootstrapping|cross-?validation", "model validation"))),
    ("STARD-AI", (DIAGNOSTIC, r"artificial\s+intelligence|machine\s+learning|deep\s+learning|\bAI\b"), (), (
        (r"training\s+(?:set|data)|held[- ]out|test\s+(?:set|data)|cross-?validation", "train/test separation"), (r"(?:image|data)\s+(?:acquisition|source)|scanner|acquisition\s+protocol", "input data acquisition"),
        (r"human[- ](?:AI|machine)|overrid|clinician\s+in\s+the\s+loop", "human-AI interaction"))),
    ("TRIPOD+AI", (PREDICTION, r"artificial\s+intelligence|machine\s+learning|deep\s+learning"), (VALIDATED,), (
        (r"fairness|subgroup\s+(?:analysis|performance)|demographic\s+groups?", "fairness/subgroup analysis"), (r"external\s+(?:validation|testing)|prospective\s+validation|transportab", "external validation"),
        (r"model\s+(?:card|specification)|full\s+(?:model|pipeline)|hyperparameters?", "full model specification"))),
    ("CONSORT-Cluster", (RCT, r"cluster\s+random|cluster-?randomi[sz]ed"), (), (
        (r"intracluster|intra-?class\s+correlation|\bICC\b|design\s+effect", "clustering accounted"), (r"number\s+of\s+clusters|\d+\s+clusters", "cluster count"))),
    ("CONSORT-Pragmatic", (RCT, r"pragmatic\s+trial|pragmatic\s+randomi"), (), (
        (r"usual\s+care|routine\s+practice|real[- ]world\s+(?:setting|conditions)", "usual-care comparator"), (r"generalizab|applicab", "applicability discussed"))),
    ("SPIRIT-extensions", (PROTOCOL, r"cluster\s+trial|pragmatic\s+trial|\bAI\b|artificial\s+intelligence"), (), (
        (r"cluster\s+level|recruitment\s+of\s+clusters|cluster\s+consent", "cluster-trial design"), (r"\bAI\b|algorithm\s+(?:input|output)|human[- ]AI", "AI intervention specification"))),
    ("TIDieR", (f"{RCT}|{ANIMAL}|{IMPROVEMENT}", r"\bintervention\b", r"session|programme|program\b|training|exercis|counsel|education|behavio|delivery|curriculum"), (PROTOCOL,), (
        (r"who\s+delivered|delivered\s+by|provider\s+(?:was|of)", "intervention provider"), (r"fidelity|adherence\s+to\s+(?:the\s+)?(?:protocol|intervention)", "fidelity assessment"),
        (r"components?\s+of\s+the\s+intervention|intervention\s+(?:consisted|involved)|what\s+(?:the\s+)?intervention", "intervention description"))),
    ("MIBBI", (r"cell\s+lines?|primary\s+cells?|organoid|passage\s+number",), (), (
        (r"authenticated?|STR\s+profil|mycoplasma", "cell-line authentication"), (r"passage\s+(?:number|range)", "passage number"))),
    ("MIAME", (r"microarray|RNA-?seq|transcriptomic\s+profil|gene[- ]expression\s+profil|\bMIAME\b",), (), (
        (r"\bGEO\b|ArrayExpress|\bSRA\b|accession|deposited", "data deposition"), (r"normaliz|\bRMA\b|DESeq|edgeR|FDR\s+correction", "normalization method"))),
    ("dMIQE", (QPCR, r"digital\s+PCR|\bdPCR\b"), (), (
        (r"droplet|chamber|partition|absolute\s+quantif", "dPCR chemistry"), (r"Poisson|confidence\s+interval|uncertainty", "measurement uncertainty"))),
    ("SAMP", (QUALITATIVE, r"audio[- ]?visual|video[- ]?record|photovoice|visual\s+method"), (), (
        (r"camera|recording\s+(?:device|equipment)|consent\s+to\s+record", "recording method"), (r"anonymi[sz]|de-?identif|blurring|face", "visual anonymity"))),
    ("COREQ", (QUALITATIVE, r"audio\s+record|verbatim|transcript(?:ion|s)?\s+of"), (), (
        (r"audio\s+record|verbatim|transcrib", "recording/transcription"), (r"participant\s+check|member\s+check|feedback\s+to\s+participants", "member checking"))),
    ("ENTREQ", (r"qualitative\s+evidence\s+synthesis|meta-?synthesis|meta-?aggregation|thematic\s+synthesis|\bENTREQ\b",), (), (
        (r"CASP|Joanna\s+Briggs|critical\s+appraisal|quality\s+appraisal", "study appraisal"), (r"thematic\s+synthesis|meta-?aggregation|line\s+by\s+line|synthesis\s+method", "synthesis method"))),
    ("CHEERS-SIM", (ECONOMIC, r"implicit\s+theory|simulation\s+model|markov|discrete[- ]event"), (), (
        (r"model\s+structure|state\s+transition|Markov\s+model|event\s+loop", "model structure"), (r"calibrat|validation\s+of\s+the\s+model|face\s+validity", "model calibration/validation"))),
)
#: DECIDE-AI: an AI trial, or the guideline's own name.
DECIDE_AI = ((r"real[- ]world|clinical\s+(?:environment|setting)|live\s+deployment|point\s+of\s+care", "real-world setting"), (r"stepped[- ]wedge|randomi[sz]ed\s+evaluation|comparator\s+(?:arm|group)", "evaluation design"))
_POOLED = r"meta-?analysis|pooled|effect\s+size|forest\s+plot"


def missing(family: str, need: tuple[str, ...], lack: tuple[str, ...], pattern: str, name: str, **more) -> Rule:
    return Rule("Reporting Guidelines", "High", f"{family}: missing {name}", need, (*lack, pattern), 0.80, f"Add the missing {name} to comply with {family}", **more)


RULES = (
    *[missing(family, need, lack, pattern, name) for family, need, lack, items in GUIDELINES for pattern, name in items],
    *[missing("DECIDE-AI", (rf"DECIDE-?AI|{RCT}",), (), pattern, name, unless=((RCT, rf"DECIDE-?AI|{AI_TRIAL}"),)) for pattern, name in DECIDE_AI],
    Rule("Reporting Guidelines", "Medium", "Heterogeneity (I2) not reported", (REVIEW, _POOLED), (r"I\s*2|I-squared|heterogeneity|tau",), 0.75, "Report I2 / tau and state the model (fixed vs random)"),
    Rule("Reporting Guidelines", "Medium", "Publication bias not assessed", (REVIEW, _POOLED), (r"funnel\s+plot|publication\s+bias|Egger|trim-and-fill",), 0.70, "Add a funnel plot or Egger test"),
)
