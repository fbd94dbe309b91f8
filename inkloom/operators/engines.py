"""Rule engines as data: methods, ethics, funding, reporting, statistics and style, one tuple of rules for each."""

from __future__ import annotations

from inkloom.operators.rules import OnLow, OnText, Rule

# Patterns, titles, severities and confidences that results are defined by.
_NON_HUMAN = (
    r"simulation[- ]only|computer\s+simulation|in\s+silico|synthetic\s+(?:data|dataset)|no\s+human\s+(?:subjects|participants)|"
    r"did\s+not\s+involve\s+(?:humans?|patients?|animals?)|publicly\s+available\s+(?:dataset|benchmark)|\bpublic\s+datasets?\b"
)
_CLINICAL = r"patient|participant|human\s+subject|clinical|trial|survey|cohort|hospital|volunteer"
_TRIAL = r"trial|randomized|randomised|intervention"
_HUMAN = ((_NON_HUMAN, r"recruit|enrol|consent|questionnair|interview"),)
_ETHICS = r"ethics\s+(?:committee|board|approval)|IRB|IEC\b|institutional\s+review|approval\s+(?:number|no\.?|ref)|protocol\s+(?:no\.?|number)"
_DATASETS = (r"\bdatasets?\b|benchmark", r"\btrain|test|val(?:idation)?")
METHODOLOGY = (
    Rule("Methodology", "Critical", "No ethics approval statement (IRB/IEC)", (_CLINICAL, _TRIAL), (_ETHICS,), 0.88, "Add an ethics-approval statement with the committee name and approval number", unless=_HUMAN),
    Rule("Methodology", "High", "No ethics approval statement (IRB/IEC)", (_CLINICAL,), (_ETHICS, _TRIAL), 0.88, "Add an ethics-approval statement with the committee name and approval number", unless=_HUMAN),
    Rule("Methodology", "High", "No informed-consent statement", (_CLINICAL,), (r"informed\s+consent|consent\s+(?:form|statement)|written\s+consent|provided\s+consent|signed\s+consent",), 0.85, "Add an informed-consent statement", unless=_HUMAN),
    Rule("Methodology", "High", "Trial not registered (no registration number)", (_CLINICAL, _TRIAL), (r"\bNCT\d+|clinicaltrials\.gov|registered\s+(?:in|with)|trial\s+registration",), 0.85, "Register the trial and report the number", unless=_HUMAN),
    Rule("Methodology", "Medium", "Randomization method not described", (_CLINICAL, _TRIAL), (r"random(?:ly|ization|ized)|allocat|assign(?:ed|ment)",), 0.75, "Describe randomization and allocation concealment", unless=_HUMAN),
    Rule("Methodology", "Medium", "Blinding not described", (_CLINICAL, _TRIAL), (r"blind(?:ed|ing)?|mask(?:ed|ing)?",), 0.70, "State which parties were blinded and how", unless=_HUMAN),
    Rule("Methodology", "High", "No animal-ethics approval (IACUC/ARRIVE)", (r"\bmice\b|\brats\b|zebrafish|animal\s+model|rodent",), (r"IACUC|ARRIVE|animal\s+(?:care|welfare|ethics)|ethics\s+(?:approval|committee)|3Rs\b|replacement|refinement",), 0.85, "Add animal-ethics approval statement and follow ARRIVE 2.0"),
    Rule("Methodology", "Medium", "No inclusion/exclusion criteria", (r"\bstudy\b|cohort|case-control|observational",), (r"inclusion\s+(?:criteria|and\s+exclusion)|exclusion\s+criteria",), 0.70, "State explicit inclusion and exclusion criteria"),
    Rule("Methodology", "Medium", "Dataset size not stated", _DATASETS, (r"\d[\d,]*\s*(?:samples?|images?|videos?|instances?|patients?|subjects?|clips?|frames?)|N\s*=\s*\d",), 0.75, "Report the number of samples/instances per dataset"),
    Rule("Methodology", "Low", "No explicit data split described", _DATASETS, (r"train(?:ing)?\s*[/-]\s*(?:test|val)|80/20|70/30|90/10|k-fold|split",), 0.65, "Describe the data split (e.g., 80/10/10, k-fold)"),
    Rule("Methodology", "Low", "Computational resources not reported", (r"train(?:ed|ing)?\b|model\s+was\s+trained",), (r"GPU|TPU|NVIDIA|A100|V100|RTX|CUDA|hours?\s+of\s+(?:training|compute)|compute\s+time|FLOPs|memory\s+usage|batch\s+size",), 0.60, "Report GPU/CPU hardware, training time, model size"),
)

ROLES = ("conceptualization", "methodology", "software", "validation", "formal analysis", "investigation", "resources", "data curation", "writing - original draft", "writing - review & editing", "visualization", "supervision", "project administration", "funding acquisition")
_COI = OnLow(r"conflict\s+of\s+interest|competing\s+interests?|declaration\s+of\s+interests?")
_FUNDED = OnLow(r"funding|grant|supported\s+by|financial\s+support")
_PAPER = OnLow(f"{_COI}|{_FUNDED}")
AUTHORSHIP = (
    Rule("Authorship", "Medium", "No CRediT contributor-role statement", (_PAPER,), (OnLow("|".join(ROLES)),), 0.75, "Add an author-contributions section using the 14 CRediT roles"),
    Rule("Authorship", "Low", "Thin CRediT coverage", (_PAPER, OnLow("|".join(ROLES))), (), 0.60, "Map all contributing authors to appropriate CRediT roles", distinct=tuple(map(OnLow, ROLES)), fewer=4),
    Rule("Authorship", "Low", "Funding declared without role-of-funders", (_FUNDED,), (OnLow(r"role\s+of\s+(?:the\s+)?funding\s+source|funders?\s+had\s+no\s+role|funding\s+sources?\s+(?:had|played)"),), 0.60, "Add: 'The funders had no role in study design, analysis, or decision to publish'"),
    Rule("Authorship", "Medium", "COI 'none declared' but commercial terms present", (_COI, OnLow(r"no\s+conflict|no\s+competing"), OnLow(r"patent|equity|stock|consult(ant|ing)|royalt")), (), 0.55, "Verify and correctly disclose any commercial interests"),
)

_PLAN_S = OnText(r"Horizon\s+(?:Europe|2020)|European\s+Research\s+Council|\bERC\b|Wellcome\s+Trust|\bUKRI\b|UK\s+Research\s+and\s+Innovation|EPSRC|ESRC|BBSRC|MRC\b")
_NIH = OnText(r"\bNIH\b|National\s+Institutes\s+of\s+Health|R\d{2}[A-Z]{2}\d*|K\d{2}[A-Z]{2}")
_FUNDER = OnText(rf"{_PLAN_S}|{_NIH}|\bNSF\b|National\s+Science\s+Foundation|\bDST\b|\bDBT\b|\bICMR\b|\bCSIR\b|Science\s+and\s+Engineering\s+Research\s+Board|\bSERB\b")
FUNDERS = (
    Rule("Funder Compliance", "Medium", "cOAlition S funder without open-access mention", (_PLAN_S,), (OnLow(r"open\s+access|creative\s+commons|CC[- ]?BY|repository|green\s+OA|gold\s+OA"),), 0.65, "Plan for immediate OA (gold/green) with a CC BY license"),
    Rule("Funder Compliance", "Low", "NIH-funded work without PMC deposit mention", (_NIH,), (OnLow(r"PMC|PubMed\s+Central|public\s+access"),), 0.60, "Note the NIH manuscript submission (NIHMS) / PMC deposit"),
    Rule("Funder Compliance", "Low", "Funding acknowledged without grant numbers", (_FUNDER, OnLow(r"fund|support")), (OnText(r"(?:grant|award|contract)\s+(?:no\.?|number[s]?|#)?\s*([A-Z0-9][A-Z0-9-]{3,})"),), 0.55, "Add complete grant/award numbers for every funder"),
    Rule("Funder Compliance", "Low", "Funder data policy without DMP reference", (_FUNDER, OnLow(r"dataset|data\s+available|data\s+shar")), (OnLow(r"data\s+management\s+plan|\bDMP\b"),), 0.45, "Mention the DMP or data-stewardship arrangement"),
)

_PREPRINT = r"arXiv|bioRxiv|medRxiv|SSRN|preprint"
LEGAL = (
    Rule("Legal & Ethics", "High", "No patient consent-for-publication statement", (r"patient|participant|human\s+subject|clinical|hospital|cohort|medical\s+record|biopsy|tissue\s+sample|survey\s+of",), (r"consent\s+(?:for\s+publication|to\s+publish|was\s+obtained|had\s+been\s+obtained|will\s+be\s+obtained)|informed\s+consent|signed\s+consent",), 0.85, "Add an informed-consent statement (and consent-for-publication if any patient is identifiable)", unless=((_NON_HUMAN, r"recruit|enrol|questionnair|interview"),)),
    Rule("Legal & Ethics", "High", "No de-identification/privacy statement", (r"medical\s+record|health\s+data|biometric|genetic\s+data|diagnos|clinical\s+data|personal\s+data|location\s+data|video\s+of\s+(?:people|subjects)|facial\s+(?:images?|data)|patient\s+images?",), (r"anonymiz|de-identif|removed\s+(?:all\s+)?identif|pseudonymiz|no\s+identifying|privacy",), 0.85, "State how identifiers were removed/anonymized (HIPAA Safe Harbor, GDPR pseudonymization, etc.)"),
    Rule("Legal & Ethics", "High", "Reused figures/tables without permission statement", (r"adapted\s+from|reprinted\s+from|reproduced\s+from|with\s+permission\s+from|taken\s+from\s+\[|used\s+with\s+permission|reproduced\s+with",), (r"permission|licensed\s+under|CC BY|copyright\s+(?:holder|owner)|obtained\s+permission|granted\s+permission",), 0.85, "Add 'Reprinted/adapted with permission from [source]' or switch to openly licensed material"),
    Rule("Legal & Ethics", "Medium", "Dual-use research without statement", (r"CRISPR|pathogen|virus\s+(?:strain|engineering)|toxin|bioweapon|bioterror|explosive|chemical\s+synthesis|nerve\s+agent|biosecurity",), (r"dual-?use|misuse|responsible\s+research|biosecurity|ethical\s+considerations?",), 0.70, "Add a dual-use/responsible-research statement"),
    Rule("Legal & Ethics", "Info", "Preprint mentioned - check journal preprint policy", (_PREPRINT,), (), 0.90, "Verify the journal's preprint policy and disclose any posted version in the cover letter"),
    Rule("Legal & Ethics", "Medium", "Prior conference/preprint version without extension note", (r"conference|workshop|presented\s+at|accepted\s+at",), (r"extended\s+(?:version|from)|substantially\s+(?:extended|revised)|earlier\s+version",), 0.70, "State how this manuscript extends the earlier version (typically 30-50% new content)"),
)

_DATA = r"data\s+(?:availab|deposited|available|repository|set)|dataset|code\s+(?:availab|repository|available)|github\.com|zenodo|figshare|dryad|osf\.io|supplementary"
_OURS = r"our\s+(?:method|approach|model|framework)|proposed\s+(?:method|approach|model)"
REPRODUCIBILITY = (
    Rule("Reproducibility", "High", "No data/code availability statement", (), (_DATA,), 0.90, "Add a Data Availability Statement with links to datasets and code", 100),
    Rule("Reproducibility", "Medium", "Data mentioned but no repository link", (_DATA,), (r"github\.com|gitlab\.com|bitbucket\.org|zenodo|figshare|dryad|osf\.io|protocols\.io|kaggle|paperswithcode|hdl\.handle\.net|doi\.org",), 0.80, "Add a URL to your data/code repository", 100),
    Rule("Reproducibility", "High", "No hyperparameters or training details", (r"neural\s+network|deep\s+learning|machine\s+learning|convolutional|transformer|fine-?tun(?:e|ing)|training\s+(?:data|set)|training\s+and\s+test|epoch|batch\s+size|learning\s+rate|back-?propagat",), (r"hyperparameter|learning\s+rate|batch\s+size|epoch|optimizer|weight\s+decay|dropout|Adam|SGD",), 0.85, "Report all hyperparameters, optimizer settings, and training details", 100),
    Rule("Reproducibility", "Medium", "No random seed mentioned", (r"random|shuffle|split|cross.valid",), (r"random\s+seed|seed\s*=|reproducib",), 0.75, "Report random seed for all stochastic processes", 100),
    Rule("Reproducibility", "Low", "No computational resources reported", (r"train|GPU|CUDA|epoch|batch",), (r"GPU|TPU|CUDA|V100|A100|RTX|compute|hardware|memory|hours",), 0.60, "Report GPU type, memory, and training time", 100),
    Rule("Reproducibility", "Medium", "No dataset description", (r"dataset|benchmark|corpus|evaluation",), (r"\d+\s*(?:samples|images|subjects|patients|participants|instances|videos)|split\s+(?:train|test|valid)|preprocess",), 0.75, "Describe dataset: size, source, preprocessing, train/test split", 100),
    Rule("Reproducibility", "Medium", "No ablation study", (_OURS,), (r"ablation|component\s+analysis|without\s+(?:component|module|layer|branch)",), 0.70, "Add ablation study showing contribution of each component", 100),
    Rule("Reproducibility", "High", "No baseline comparison", (r"our\s+(?:method|approach|model|framework)|proposed\s+(?:method|approach)",), (r"baseline|SOTA|state.of.the.art|compared\s+to|outperform",), 0.85, "Compare with at least 3 relevant baselines", 100),
)

#: Short checklists: (title before the item's name, patterns needed, confidence, how the action ends, items (pattern, name)).
_SHORT = (
    ("Diagnostic study missing", r"diagnostic\s+(?:accuracy|test)|sensitivity\s+and\s+specificity|ROC|AUC\b|receiver\s+operating", 0.75, "STARD 2015", (
        (r"reference\s+standard|gold\s+standard", "Reference standard defined"), (r"\bsample\s+size|patients?\s+(?:included|recruited)|N\s*=\s*\d", "Sample size stated"), (r"sensitivity|specificity|accuracy|AUC|ROC", "Accuracy measures reported"))),
    ("Prediction model missing", r"predict(?:ion|ive)?\s+model|risk\s+score|prognostic\s+model|nomogram|machine\s+learning\s+model.*predict", 0.75, "TRIPOD", (
        (r"validat(?:ed|ion)|external|test\s+set|hold-?out", "Model validation"), (r"AUC|C-?statistic|calibration|Brier|discrimination", "Discrimination/calibration"), (r"predict(?:ors?|ive)\s+(?:variables?|features?)|covariates", "Predictors defined"))),
    ("Qualitative study missing", r"qualitative\s+(?:study|research|analysis)|semi-?structured\s+interviews|focus\s+groups|thematic\s+analysis|grounded\s+theory|phenomenolog", 0.70, "COREQ (32 items) / SRQR (21 items)", (
        (r"reflexiv|positionalit|researcher\s+(?:role|background)|the\s+author", "Reflexivity statement"), (r"saturat(?:ed|ion)", "Data saturation discussed"),
        (r"member\s+checking|participant\s+validation|respondent\s+validation", "Member checking"), (r"cod(?:ing|es?)|thematic|framework|software\s+\(?NVivo|MAXQDA", "Coding process described"))),
    ("Observational meta-analysis missing", OnLow(r"meta-?analysis\s+of\s+(?:observational|cohort|case-?control)|pooled\s+(?:odds\s+ratio|risk\s+ratio|relative\s+risk)"), 0.75, "MOOSE", (
        (OnLow(r"i-?squared|heterogeneity"), "Heterogeneity quantified (I2)"), (OnLow(r"funnel|egger|publication\s+bias"), "Publication bias assessed"), (OnLow(r"fixed\s+effects|random-?effects?"), "Pooling model stated"), (OnLow(r"subgroup|sensitivity\s+anal"), "Subgroup/sensitivity analyses"))),
    ("Non-randomized intervention missing", OnLow(r"(?:non-?randomi[sz]ed|quasi-?experimental|pre-?post|before-?after)\s+(?:trial|study|design|intervention)|stepped-?wedge"), 0.70, "TREND", (
        (OnLow(r"baseline\s+(?:equivalence|characteristics|compar)"), "Baseline equivalence"), (OnLow(r"confound"), "Confounder handling"), (OnLow(r"theory\s+of\s+change|behavioral\s+(?:theory|change)|intervention\s+theory"), "Intervention rationale"))),
    ("Genetic association study missing", OnLow(r"genome-?wide|SNPs?\b|genetic\s+association|GWAS|alleles?\b|genotypes?\b|polymorphism"), 0.70, "STREGA", (
        (OnLow(r"hardy[- ]weinberg|hwe\b"), "Hardy-Weinberg equilibrium"), (OnLow(r"ancestry|population\s+stratification|ethnic"), "Ancestry/stratification"), (OnLow(r"call\s+rate|quality\s+control|qc\b|genotyping\s+error"), "Genotyping QC"))),
    ("Health-economic evaluation missing", OnLow(r"cost-?(?:effectiveness|utility|benefit)|QALY|ICER\b|incremental\s+cost|economic\s+evaluation"), 0.70, "CHEERS", (
        (OnLow(r"time\s+horizon|perspective\s+(?:of|:)"), "Perspective & time horizon"), (OnLow(r"discount(?:ing|ed)?\b"), "Discounting"), (OnLow(r"uncertainty|probabilistic|sensitivity\s+anal"), "Uncertainty analysis"), (OnLow(r"currency|usd|eur|inr|\$"), "Currency & price date"))),
    ("Scoping review missing", OnLow(r"scoping\s+review"), 0.65, "PRISMA-ScR", (
        (OnLow(r"protocol|registered|a\s+priori"), "A-priori protocol"), (OnLow(r"data\s+chart(?:ing)?|extraction\s+form"), "Charting process"))),
)
CHECKLISTS = (
    *[Rule("Reporting Guidelines", "Medium", f"{title} {name}", (trigger,), (pattern,), conf, f"Add {name} per {guide}") for title, trigger, conf, guide, items in _SHORT for pattern, name in items],
    Rule("Reporting Guidelines", "Medium", "Case report without consent-for-publication", (r"case\s+report|we\s+report\s+a\s+(?:case|patient)",), (r"CARE\b|case\s+report\s+guidelines", r"consent\s+(?:for\s+publication|to\s+publish|was\s+obtained)"), 0.80, "Add written informed consent-for-publication (per CARE)"),
    Rule("Reporting Guidelines", "Medium", "Trial protocol without registration", (r"study\s+protocol|trial\s+protocol|SPIRIT",), (r"\bNCT\d+|clinicaltrials\.gov|registration|registered",), 0.80, "Register the protocol and cite the registration number (SPIRIT)"),
)

_SURVIVAL = r"Kaplan-?Meier|survival\s+(?:analysis|curve|rate)|time-to-event|hazard\s+ratio|Cox\s+(?:proportional|regression)|log-?rank|censored"
_BAYES = r"Bayesian|Bayes\s+factor|posterior|MCMC|Stan|JAGS|BUGS|credible\s+interval"
_NUMBERS = r"p\s*[<>=]\s*0?\.\d+|statistically\s+significant|effect\s+size|\bCI\b|standard\s+(?:deviation|error)|±|confidence\s+interval"
STATISTICS_DEEP = (
    Rule("Statistics", "High", "Survival analysis without censoring description", (_SURVIVAL,), (r"censored|censoring|withdrawn|lost\s+to\s+follow",), 0.85, "Describe how censoring was handled (right-censoring, withdrawals)"),
    Rule("Statistics", "Medium", "Kaplan-Meier curves without log-rank comparison", (r"Kaplan-?Meier|survival\s+curve",), (r"log-?rank|Mantel-?Cox",), 0.75, "Add a log-rank test when comparing two or more survival curves"),
    Rule("Statistics", "Medium", "Hazard ratios without confidence intervals", (r"hazard\s+ratio",), (r"95%\s*(?:CI|confidence|confidence\s+interval)|CI\s*[:\[]",), 0.75, "Report HR with 95% CI and p-value"),
    Rule("Statistics", "High", "Bayesian analysis without prior justification", (_BAYES,), (r"prior(?:s)?\b",), 0.85, "State each prior (distribution + parameters) and why it was chosen"),
    Rule("Statistics", "Medium", "Bayesian results reported as confidence intervals", (r"Bayesian|posterior", r"confidence\s+interval"), (r"credible",), 0.80, "Report credible intervals and never call them confidence intervals"),
    Rule("Statistics", "Low", "No prior-sensitivity analysis reported", (_BAYES,), (r"sensitivity\s+analysis|robustness|alternative\s+prior",), 0.65, "Add a sensitivity analysis across prior choices"),
    Rule("Statistics", "Medium", "Suspicious p-value clustering near 0.05", (), (), 0.60, "Report all analyses run (including non-significant ones) and pre-register hypotheses", counts=(((r"p\s*[=<]\s*0?\.04",), 3), ((r"p\s*[=<]\s*0?\.\d{2,3}",), 5))),
    Rule("Statistics", "Medium", "Parametric tests without normality check", (r"\bt[- ]test\b|ANOVA|Pearson|linear\s+regression|parametric", _NUMBERS), (r"normality|Shapiro-?Wilk|Kolmogorov-?Smirnov|normal\s+distribution|log-?transform",), 0.70, "Test and report normality (Shapiro-Wilk) or justify robustness (large n, CLT)"),
    Rule("Statistics", "Low", "Error bars without definition", (r"error\s+bars?",), (r"SD|SE|standard\s+(?:deviation|error)|95%\s*CI|confidence\s+interval",), 0.70, "State what error bars represent in each figure caption"),
    Rule("Statistics", "Low", "Statistical software not reported", (_NUMBERS,), (r"\b(R|SPSS|SAS|Stata|GraphPad|Matlab|SciPy|scikit-learn)\b\s*(?:version|v?\d)", r"analy(?:zed|sis)|statistical\s+(?:analysis|software)|computed\s+using"), 0.60, "State the software and version (e.g., R 4.3.2, SPSS 29)"),
)

_SIM = r"finite\s+element|\bFEA\b|\bCFD\b|computational\s+fluid|finite\s+volume|finite\s+difference|mesh(?:ing)?\s+(?:was|generation|refinement)|\bFEM\b|multiphysics|discretiz|Navier[- ]Stokes|LES\b|\bDNS\b|\bRANS\b|k[- ]epsilon|grid\s+generation|solver|Monte\s+Carlo|polynomial\s+chaos"
_VV = (
    ("Medium", "No mesh/grid/time-step independence study (ASME V&V)", r"mesh\s+(?:independence|convergence|refinement\s+study)|grid\s+(?:independence|convergence)|time[- ]step\s+(?:independence|convergence)|convergence\s+(?:study|test|analysis)|grid\s+convergence\s+index|\bGCI\b|Richardson\s+extrapolat|h-?refinement\s+study|element\s+(?:count|size)\s+(?:was|is)\s+(?:varied|increased|refined)|coarser|finer\s+mesh", 0.85, "Add a mesh-independence section: 3+ resolutions, monitored quantity, GCI or Richardson extrapolation"),
    ("Medium", "No validation against experimental or analytical data (ASME V&V)", r"validat(?:ed?|ing|ion)\s+against|compared\s+(?:with|to|against)\s+(?:the\s+)?(?:experimental|measured|analytical|literature)\s+(?:results?|data|values?)|experimental\s+(?:validation|data\s+for\s+(?:comparison|verification))|benchmark\s+(?:problem|case|solution)|analytical\s+solution|agreement\s+(?:within|of)\s+\d+(?:\.\d+)?\s*%|deviat(?:es?|ion)\s+.{0,30}\d+(?:\.\d+)?\s*%|code[- ]to[- ]code\s+(?:comparison|verification)|method\s+of\s+manufactured\s+solutions", 0.85, "Add a validation section with quantitative deviation vs experiment/analytical/benchmark data"),
    ("Low", "Solver, version, and discretization schemes not identified", r"(?:commercial|open[- ]source)\s+solver|ansys|comsol|abaqus|openfoam|fluent|star[- ]ccm|ls[- ]dyna|fenics|code_saturne|\bsu2\b|mfix|solver\s+(?:version|used|was)|second[- ]order\s+(?:upwind|accurate)|first[- ]order|upwind|central\s+differenc|simple\s+algorithm|\bpiso\b|\bpimple\b|galerkin|discretization\s+scheme|turbulence\s+model", 0.75, "Name the solver + version, spatial/temporal schemes, and turbulence/constitutive models"),
    ("Medium", "Boundary conditions not specified", r"boundary\s+conditions?\s+(?:were|are|applied|set|imposed|prescribed)|no[- ]slip|free[- ]slip|dirichlet|neumann|inlet\s+velocity|outlet\s+(?:pressure|boundary)|fixed\s+(?:support|constraint)|clamped|symmetry\s+boundary|prescribed\s+(?:displacement|temperature|pressure)|initial\s+conditions?", 0.80, "Add a table of boundary/initial conditions with values for each domain face"),
    ("Medium", "No uncertainty quantification (NASA-STD-7009 / ASME V&V)", r"uncertainty\s+(?:quantification|analysis|of|estimate|\bUQ\b)|\bUQ\b|error\s+(?:estimate|bar)|confidence\s+(?:interval|band)|sensitivity\s+(?:of|analysis|study)|sensitivit(?:y|ies)\s+to\s+(?:mesh|parameters?|input)|Monte\s+Carlo|polynomial\s+chaos|sobol|aleator|epistemic", 0.80, "Add uncertainty quantification: sensitivity to key inputs and mesh, error bars on predicted quantities"),
    ("Low", "Compute environment not reported", r"(?:intel|amd|xeon|epyc|core\s+i[579]|ryzen|threadripper)\b|gpu\s*(?:model)?\s*[:=]|\brtx\b|\bgtx\b|\ba100\b|\bh100\b|\bv100\b|\d+\s*gb\s+(?:ram|memory)|compute\s+node|hpc\s+cluster|parallel(?:ized)?\s+on\s+\d+\s+cores", 0.55, "Report CPU/GPU model, core count, memory, and runtime"),
)
ENGINEERING = (
    *[Rule("Engineering V&V", severity, title, (_SIM,), (OnLow(pattern),), conf, action, least_tokens=200) for severity, title, pattern, conf, action in _VV],
    Rule("Engineering V&V", "Low", "Material/constitutive properties without a source", (_SIM, OnLow(r"material\s+(?:properties|model|behavi)|constitutive|young'?s\s+modulus|density\s+of|thermal\s+conductivity|viscosity")), (OnLow(r"properties\s+(?:were\s+)?(?:taken|obtained|sourced|measured|tabulated)\s+from|from\s+the\s+literature|\[\d+\]\s*.{0,30}(?:properties|data)|measured\s+(?:using|via|by)|supplier|datasheet|handbook|standard\s+(?:ASTM|ISO)\s*\d+|tabulated\s+in\s+table"),), 0.65, "Cite or measure every material/constitutive parameter; tabulate them with sources", least_tokens=200),
)

VENUE_GENERAL = (
    Rule("Venue Extras", "Low", "Medical paper without plain-language summary", (OnLow(r"clinical|public\s+health|medical"),), (OnLow(r"plain\s+language|lay\s+summary|non-?specialist|general\s+audience"),), 0.55, "Add a plain-language summary of the findings"),
    Rule("Venue Extras", "Low", "No suggested-reviewer list reminder", (), (OnLow(r"suggested\s+reviewers?|preferred\s+reviewers?"),), 0.45, "Prepare a list of 3-5 qualified, conflict-free reviewers for the submission portal"),
    Rule("Submission", "High", "Venue red flag: fast-track/guaranteed acceptance language", (r"fast\s+(?:track|review|publication)|quick\s+review|guaranteed\s+acceptance|acceptance\s+within\s+\d+\s+(?:days|weeks)|waiv(?:er|ed)\s+(?:fee|apc)|discount\s+on\s+publication",), (), 0.85, "Re-verify the venue with Think.Check.Submit before submitting"),
    Rule("Submission", "Medium", "Submission may originate from an unsolicited invitation", (r"invited?\s+(?:to|by)|solicit|we\s+are\s+pleased\s+to\s+invite|call\s+for\s+papers|special\s+issue\s+invitation",), (), 0.60, "If you were invited via spam email, run the venue through Think.Check.Submit first"),
    Rule("Submission", "Info", "Submission-package checklist", (), (), 0.90, "Prepare: cover letter, suggested reviewers, ORCID links, line numbers, and the items listed", distinct=(r"running\s+head|short\s+title", r"graphical\s+abstract", r"plain\s+language\s+summary|lay\s+summary"), fewer=3),
)

_TRIAL_RCT = OnLow(r"randomized\s+controlled\s+trial|randomised\s+controlled\s+trial|\bRCT\b|randomly\s+(?:assigned|allocated|allocated\s+to)|random\s+(?:assignment|allocation|ization)")
_REGISTRY = r"\b(?:NCT\d{8}|ISRCTN\d{8,10}|ChiCTR[\w-]+\d+|ACTRN\d{14}|EudraCT\s*\d{4}-\d{6}-\d{2}|DRKS\d{6}|UTRN[A-Z]?\d+|PACTR[\w-]+\d+|JPRN-[A-Z]+-\d+|IRCT\d{8,12}|CHICTR[\w-]+\d+|NCTR\d+|TCTR[\w-]+\d+)"
_PEOPLE = OnLow(r"participants?\s+(?:were|was|enrolled|recruited)|patients?\s+(?:were|was|enrolled|recruited|included)|subjects?\s+(?:were|was|enrolled|recruited)|informed\s+consent|human\s+(?:subjects?|participants?)")
_APPROVED = OnLow(
    r"(?:ethics|IRB|IEC|institutional\s+review\s+board|ethics\s+committee|review\s+board|ethical\s+approval|approved\s+by)\s+(?:committee|board|approval|review)|"
    r"(?:was|were)\s+(?:approved|reviewed|authorized)\s+by\s+(?:the\s+)?(?:ethics|IRB|IEC|institutional\s+review)|approved\s+by\s+(?:the\s+)?[a-z][\w\s,&\-]{0,60}?(?:irb|iec|institutional\s+review\s+board|ethics\s+committee)\b|"
    r"ethical\s+(?:approval|clearance|permit)|institutional\s+review\s+board\s+\((?:IRB|IEC)\)|experiment(?:s)?\s+were\s+performed\s+(?:in\s+accordance|according)\s+with"
)
_CONSENT = OnLow(r"informed\s+consent|written\s+consent|oral\s+consent|consent\s+(?:was\s+)?(?:obtained|received|collected|given|provided)|consent\s+(?:form|document|process)|participant(?:s)?\s+(?:gave|provided|signed|gave\s+written)\s+(?:informed\s+)?consent")
_AVAILABLE = OnLow(
    r"data\s+(?:availability|sharing|access)\s+statement|code\s+(?:availability|sharing|access)\s+statement|(?:data|code)\s+(?:is|are)\s+(?:available|accessible|deposited)|"
    r"(?:available|obtainable)\s+(?:from|upon|on)\s+(?:the\s+)?(?:corresponding\s+author|first\s+author|request)|available\s+on\s+reasonable\s+request|supplementary\s+(?:data|material|information)\s+(?:is\s+)?(?:available|attached)|github\.com|zenodo\.org|figshare\.com|dryad\.org|osf\.io"
)
TRIAL_ETHICS = (
    Rule("Trial Registration", "High", "RCT detected without trial registration ID", (_TRIAL_RCT,), (_REGISTRY,), 0.85, "Register the trial at ClinicalTrials.gov (NCT), ISRCTN, or a WHO ICTRP primary registry, and include the registration ID in the abstract and methods", least_tokens=200),
    Rule("Ethics", "High", "Human study detected without ethics approval statement", (_PEOPLE,), (_APPROVED,), 0.80, "Add an ethics approval statement including the IRB/IEC name, approval number, and date of approval to the Methods section", least_tokens=200),
    Rule("Ethics", "High", "Human study detected without informed consent statement", (_PEOPLE,), (_CONSENT,), 0.80, "Add a statement confirming informed consent was obtained from all participants, or explain why consent was waived", least_tokens=200),
    Rule("Ethics", "Medium", "Animal study detected without welfare compliance statement", (OnLow(r"\bmice\b|\brats?\b|\bzebrafish\b|\bmouse\b|\brat\b|animal\s+(?:model|study|experiment)|rodents?\b"),), (OnLow(r"(?:IACUC|institutional\s+animal\s+(?:care|committee))|animal\s+(?:care|use|welfare)\s+(?:committee|board)|ARRIVE\s+(?:guidelines|checklist)|approved\s+by\s+(?:the\s+)?(?:animal|veterinary)"),), 0.70, "Add IACUC/animal ethics approval and confirm ARRIVE guidelines compliance", least_tokens=200),
    Rule("Data Availability", "Medium", "Funded work without data/code availability statement", (OnLow(r"(?:funded|supported|financed)\s+by|(?:grant|contract|award)\s+(?:number|no\.?|#|ID)|funding\s+(?:source|agency|body|organization)"),), (_AVAILABLE,), 0.65, "Add a Data Availability Statement indicating where data/code can be accessed, or state any restrictions", least_tokens=200),
)

_US = OnText(r"National\s+(?:Institutes?\s+of\s+Health|Science\s+Foundation)|\bNIH\b\s+(?:grant|funding|award)|\bNSF\b\s+(?:grant|funding|award)|DOE\s+(?:grant|award|funding)|NASA\s+(?:grant|award)|\bDARPA\b|\bONR\b|department\s+of\s+energy\s+(?:grant|award)")
COUNTRIES = (
    Rule("Country Standards", "Medium", "Indian funder detected: UGC 2018 plagiarism tiers + NIRF retraction penalty apply", (OnText(r"university\s+grants\s+commission|\bUGC\b|ANRF|SERB\b|DST\s+India|DBT\s+India|ICMR|CSIR\b|Ministry\s+of\s+Education\s+\(India\)|MHRD|AICTE|Indian\s+(?:Council|Institute|National)\s+"),), (), 0.75, "Run the similarity check against the UGC tiers (engine: ugc_plagiarism) and declare any AI use per UGC 2026 policy", least_tokens=200),
    Rule("Country Standards", "Medium", "Chinese funder detected: MOE early-warning list + national retraction-review disclosure apply", (OnText(r"National\s+Natural\s+Science\s+Foundation\s+of\s+China|\bNSFC\b|Chinese\s+Ministry\s+of\s+(?:Science|Education)|MOST\s+grant|China\s+Scholarship\s+Council|\bCSC\b\s+grant|Chinese\s+Academy\s+of\s+Sciences"),), (), 0.75, "Check the target journal against the early-warning list", least_tokens=200),
    Rule("Country Standards", "Medium", "US federal funder detected: Nelson Memo / NIH DMS compliance gaps", (_US,), (), 0.75, "Add an immediate-OA statement and a data-availability statement naming a repository (PubMed Central, Zenodo, etc.)", least_tokens=200, distinct=(OnLow(r"creative\s+commons|open\s+access|accepted\s+manuscript|public\s+access|repository|PubMed\s+Central|arXiv|Zenodo|deposit"), OnLow(r"data\s+(?:management|sharing)|data\s+availab|supplementary\s+data|deposited\s+(?:in|at)|available\s+at\s+https?://")), fewer=2),
    Rule("Country Standards", "Medium", "cOAlition S funder detected: Rights Retention Strategy not evident", (OnText(r"European\s+(?:Research\s+Council|Commission|Union)|\bERC\b\s+(?:grant|funding|award)|Horizon\s+(?:2020|Europe)|FET\s+Open|Marie\s+(?:Sklodowska|Curie)|cOAlition\s+S|Wellcome\s+Trust|Templeton\s+World\s+Charity|Robert\s+Bosch\s+Stiftung|Austrian\s+Science\s+Fund|FWF\s+grant|Dutch\s+Research\s+Council|NWO|Swiss\s+National\s+Science\s+Foundation|\bSNSF\b|Finnish\s+Academy|Research\s+Council\s+of\s+Norway"),), (OnLow(r"rights\s+retention|CC\s*BY|creative\s+commons\s+attribution|open\s+access|preprint"),), 0.75, "Add the RRS acknowledgment string verbatim and plan Gold OA (or compliant Green) deposit", least_tokens=200),
    Rule("Country Standards", "Low", "Japanese funder detected: MEXT misconduct-guideline definitions apply", (OnText(r"Japan\s+(?:Society\s+for\s+the\s+Promotion\s+of\s+Science|Science\s+and\s+Technology\s+Agency)|\bJSPS\b\s+(?:grant|KAKENHI)|KAKENHI|JST\s+(?:grant|funding)|MEXT\s+(?:grant|funding)|Japan\s+Agency\s+for\s+Medical\s+Research|AMED\s+grant"),), (), 0.70, "State completed integrity training if asked", least_tokens=200),
    Rule("Country Standards", "Low", "Korean funder detected: KCI similarity screening + KISTI registration context", (OnText(r"National\s+Research\s+Foundation\s+of\s+Korea|\bNRF\b\s+grant\s*\(?(?:Korea|Republic)|Ministry\s+of\s+(?:Education|Science\s+and\s+ICT)\s+of\s+Korea|Korea\s+Institute\s+of\s+(?:Science\s+and\s+Technology\s+Evaluation|Advancement\s+of\s+Technology)|\bKISTE\b|\bKISTI\b|Korea\s+Health\s+Industry\s+Development\s+Institute|\bKHIDI\b"),), (), 0.70, "Report the registered project number", least_tokens=200),
)

_SIG = r"\bp\s*[<>=]\s*0?\.\d+|\bp-value"
CLAIMS = (
    Rule("Claims", "Medium", "'Significant' used without reported statistics", (), (_SIG,), 0.80, "Report actual p-values (or CIs/effect sizes) for every significance claim.", 100, counts=(((r"\bsignifican\w*",), 3),)),
    Rule("Claims", "Low", "Effect sizes missing", (_SIG, r"\b\d+(?:\.\d+)?\s*(?:%|percent)|accuracy|precision|recall|f1|score"), (r"\b(cohen'?s?\s*d|d\s*=|eta.?squared|η2?|r\s*=|partial.?eta|hedges)",), 0.60, "Add effect sizes; 'p < 0.05' alone is considered weak reporting by many journals.", 100),
    *[Rule("Claims", "Medium", f"Frequent use of '{label}' ({{n}} times)", (), (), 0.80, f"Justify every use of '{label}' or soften language (e.g., 'novel' → 'a new')", counts=(((pattern,), 3),)) for pattern, label in (
        (r"\bnovel\b", "novel"), (r"\bfirst\b.*(?:to|in|we|this|our)", "first"), (r"\bunprecedented\b", "unprecedented"), (r"\bunique\b", "unique"), (r"\bbreakthrough\b", "breakthrough"), (r"\bgroundbreaking\b", "groundbreaking"),
        (r"\bpioneer", "pioneer"), (r"\bstate-of-the-art\b", "state-of-the-art"), (r"\bcutting.edge\b", "cutting-edge"), (r"\brevolutionary\b", "revolutionary"), (r"\btransformative\b", "transformative"))],
    Rule("Claims", "Medium", "Excessive hedging language ({n} instances)", (), (), 0.75, "Reduce hedging — state findings directly where evidence supports them", counts=(((r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bpossibly\b", r"\bpotentially\b", r"\bsuggests?\b", r"\bappears?\b", r"\bseems?\b", r"\blikely\b", r"\bperhaps\b"), 1),), per_1000=15.0),
    Rule("Claims", "High", "Causal claims from observational data", (r"cross-?sectional|cohort|observational|correlation|associat(?:ed|ion)|retrospective|survey", r"\b(causes?|leads?\s+to|results?\s+in|improves?|reduces?|prevents?|proves?|demonstrates?\s+that|guarantees?|drives?)\b"), (r"randomized\s+controlled\s+trial|randomised\s+controlled\s+trial|\bRCT\b|double-?blind",), 0.85, "Replace causal verbs with association language ('is associated with', 'correlates with') or qualify as hypothesis-generating"),
)

_P_GATE = r"\bp\s*[<>=]\s*0?\.\d|p-?value"
_EFFECT = r"cohen'?s?\s+d|hedges'?s?\s*g|odds\s+ratio|risk\s+ratio|hazard\s+ratio|η\s*2|eta\s*(?:squared)?|effect\s+size|r\s*2\b|partial\s+η|glass'?s?\s+δ|percent(?:age)?\s+(?:difference|improvement|change|increase|reduction)|mean\s+difference|standardi[sz]ed\s+(?:beta|coefficient)"
_CI = r"95\s*%\s*CI|confidence\s+interval|CI\s*[\[(]\s*[\d.]+\s*[,–-]"
ASA = (
    Rule("ASA p-values", "High", "Significance claimed with no effect size reported (ASA principle 3)", (_P_GATE, r"statistically\s+significant|significant(?:ly)?\s+(?:differ|increase|decrease|effect|improv|reduc|correlat)|\bsignificance\b"), (_EFFECT,), 0.85, "Add effect sizes (with CIs) for every primary comparison", least_tokens=200),
    Rule("ASA p-values", "Medium", "Only threshold p-values reported (ASA principle 2)", (_P_GATE, r"p\s*<\s*0\.0\d|p\s*<\s*\.0\d"), (r"p\s*=\s*0?\.\d+",), 0.75, "Report exact p-values (e.g., p = .032) rather than thresholds only", least_tokens=200),
    Rule("ASA p-values", "Medium", "p-value used as a magnitude claim (ASA principle 4)", (_P_GATE, r"highly\s+significant|very\s+significant|extremely\s+significant|strongly\s+significant|more\s+significant"), (), 0.85, "Replace magnitude adjectives with the measured effect size", least_tokens=200),
    Rule("ASA p-values", "Medium", "Absence of significance read as absence of effect (ASA principle 5)", (_P_GATE, r"(?:no|not)\s+significant(?:ly)?\s+(?:difference|effect|association|correlation|change|differ)|(?:were|was)\s+not\s+significant.{0,40}(?:no|therefore|thus|hence).{0,60}(?:no\s+difference|equivalent|same|absent|absence)"), (_CI, _EFFECT), 0.75, "Report CIs around the estimate, or run equivalence testing before claiming 'no effect'", least_tokens=200),
    Rule("ASA p-values", "Medium", "p-value framed as proof of the hypothesis (ASA principle 1)", (_P_GATE, r"p(?:-|\s)value?s?\s+(?:proves?|confirms?|establishes?|demonstrates?|validates?)|proves?\s+(?:the\s+)?(?:hypothesis|effect|association)"), (), 0.80, "Rephrase as evidence against the null model, not proof of the hypothesis", least_tokens=200),
    Rule("ASA p-values", "Low", "Significance euphemism for a nonsignificant result (ASA principle 6)", (_P_GATE, r"marginal(?:ly)?\s+significant|tenden(?:cy|d)\s+toward\s+significance|approach(?:ed|ing)?\s+significance|borderline\s+significant|trending\s+towards?\s+significance"), (), 0.70, "Report the exact p-value and interpret the result as nonsignificant (or pre-register a one-sided test)", least_tokens=200),
)

_STUDIED = OnLow(r"participants?\s+(?:were|was)|patients?\s+(?:were|was|enrolled|recruited)|subjects?\s+(?:were|was)|respondents?|undergraduate|surveyed|enrolled|recruited|consecutive\s+(?:patients|cases)|\bparticipants?\b|\bpatients?\b|\bsubjects?\b")
#: Who is studied without a verb of recruitment doesn't count unless an action stands somewhere.
_ACTED = ((OnLow(r"\bparticipants?\b|\bpatients?\b|\bsubjects?\b"), OnLow(r"participants?\s+(?:were|was)|patients?\s+(?:were|was|enrolled|recruited)|subjects?\s+(?:were|was)|respondents?|undergraduate|surveyed|enrolled|recruited|consecutive\s+(?:patients|cases)|assigned|allocated|consented|followed|completed|randomi[sz]ed")),)
_POWER = OnLow(r"power\s+(?:calculation|analysis|of)|a\s+priori\s+power|sample[- ]size\s+(?:calculation|justification|determination|was)\b|G\*?Power|statistical\s+power|powered\s+to\s+detect|adequate\s+(?:statistical\s+)?power|calculated\s+(?:a\s+)?sample\s+size|effect\s+size\s+(?:of|assumed|expected)")
POWER = (
    Rule("Power & Sample Size", "Medium", "No sample-size justification found in a participant study", (_STUDIED,), (_POWER, OnLow(r"corpus|benchmark|dataset\s+(?:of|with)\s+\d{3,}|large[- ]scale|log\s+data|telemetry|secondary\s+(?:data|analysis)|registry\s+data|administrative\s+data")), 0.80, "Add a sample-size / power justification to the Methods section", least_tokens=200, unless=_ACTED),
    Rule("Power & Sample Size", "Medium", "Small sample framed with high-certainty language", (_STUDIED, OnLow(r"\bn\s*=\s*(?:[1-9]|1\d|2\d)\b(?:\s*per\s*(?:group|arm|condition|site))?"), OnLow(r"robust|conclusive|definitive|well[- ]powered|sufficient\s+power|strong\s+evidence")), (), 0.75, "Soften the certainty language and add small-sample limitations, or justify the n via power analysis", least_tokens=200, unless=_ACTED),
    Rule("Power & Sample Size", "Low", "Power analysis named but its parameters are missing", (_STUDIED, OnLow(r"power\s+(?:calculation|analysis)|G\*?Power|statistical\s+power")), (OnLow(r"0?\.\d{1,2}\b\s*(?:power|β)|power\s*(?:of)?\s*0?\.\d{1,2}|α\s*=\s*0?\.\d{1,2}|alpha\s*=\s*0?\.\d{1,2}|d\s*=\s*0?\.\d{1,2}|effect\s+size\s*(?:of)?\s*0?\.\d{1,2}"),), 0.70, "State the assumed effect size, alpha, power, and the software used (e.g., G*Power 3.1.9.7)", least_tokens=200, unless=_ACTED),
)

_ML = r"\b(?:accurac(?:y|ies)|f1[- ]?scores?|precisions?|recalls?|neurals?|transformers?|classifiers?|training\s+sets?|benchmarks?|datasets?|convolutional|neural\s+network)"
_TUNING = r"grid\s*search|hyperparameter\s*(?:search|tuning|optimization)|(?:we\s+)?tun(?:e|ed|ing)\s+(?:the|our)|random\s*search|bayesian\s*optimization|sweep(?:s|ed)?\s+over|learning[\s-]*rate\s*(?:search|sweep)"
_FAIR = r"baseline[s]?\s+(?:are|were|is)\s+tuned|tuned\s+baselines?|identical\s+(?:tuning|hyperparameter|budget)|fair\s+comparison|same\s+(?:tuning|search)\s+budget|baselines?\s+under\s+the\s+same"
FAIRNESS = (
    Rule("ML Fairness", "Medium", "Baselines appear untuned (fair-comparison risk)", (_ML,), (_FAIR,), 0.60, "Add an explicit fair-comparison statement: identical tuning budgets, seeds, and hardware for every baseline, or tune the baselines too.", 200, counts=(((_TUNING,), 2),)),
    Rule("ML Fairness", "Info", "Fair-comparison protocol present", (_ML, _TUNING, _FAIR), (), 0.55, "No action needed.", 200),
    Rule("ML Fairness", "Medium", "Accuracy-only reporting on imbalanced data", (_ML, r"class[\s-]*imbalance|imbalanc(?:ed?|es)|minority\s+class|skew(?:ed)?\s+(?:class|distribution)|\d+\s*[:%]\s*\d+\s*(?:ratio|split)|rare\s+class|long[- ]tailed\s+distribution", r"9\d(?:\.\d+)?\s*%\s*(?:accuracy|acc\b)|(?:accuracy|acc\b)\s*(?:of|=)\s*9\d(?:\.\d+)?\s*%"), (r"balanced\s+accuracy|macro[\s-]*f1|macro\s*averaged|mcc|matthews|pr[\s-]*auc|area\s+under\s+the\s+precision|cohen'?s?\s+kappa|g[\s-]*mean|sensitivity\s+and\s+specificity|auc\b|roc[\s-]*auc",), 0.65, "Report balanced accuracy, macro F1, MCC, or PR-AUC alongside accuracy; state the class distribution explicitly.", 200),
)

_GAPS = (
    r"it\s+is\s+(?:trivial|easy|straightforward|simple)\s+to\s+(?:see|show|verify|prove|check)", r"trivially[,]?", r"obviously[,]?", r"it\s+can\s+easily\s+be\s+shown", r"by\s+simple\s+(?:algebra|substitution|induction|inspection|calculation)",
    r"the\s+(?:proof|details)\s+are\s+(?:omitted|left\s+to\s+the\s+reader|straightforward)", r"we\s+omit\s+the\s+(?:proof|details)", r"clearly[,]?\s+(?:holds|satisfies|follows|converges)", r"immediately\s+(?:follows|gives|yields)", r"as\s+is\s+well\s+known",
)
_MATH = r"\\begin\{(?:theorem|lemma|proposition|proof)\}|theorem\s+\d|lemma\s+\d|proof\.|O\(n|big-O|\bwe\s+prove\b|\bproof\s+of\s+theorem"
PROOFS = (
    Rule("Rigor", "Medium", "Proof-gap dismissal phrases invite the 'Nitpicker' objection", (_MATH,), (), 0.60, "Replace each dismissal with the actual step, a short appendix proof, or a citation to where the step is proven.", 200, counts=((_GAPS, 3),)),
    Rule("Rigor", "Low", "Dismissal phrasing in formal sections", (_MATH,), (), 0.45, "Spot-check that each 'trivially' corresponds to a step a reviewer can verify in one line.", 200, counts=((_GAPS, 2),), count_most=2),
)

_NOMINAL = r"\b(?:utilization|operationalization|prioritization|conceptualization|maximization|minimization|implementation|characterization|normalization|optimization|generalization)\b"
STYLE = (
    Rule("Writing Depth", "Medium", "Weasel words overused ({n} instances)", (), (), 0.85, "Delete or replace with concrete evidence for each instance", counts=(((r"\b(?:clearly|obviously|undoubtedly|unquestionably|basically|essentially|evidently|presumably|arguably|notably|interestingly|importantly|simply|merely|quite|rather|somewhat|relatively|comparatively)\b",), 4),)),
    Rule("Writing Depth", "Medium", "Filler phrases ({n} instances)", (), (), 0.90, "Replace with direct forms: 'because', 'about', 'to', 'in'", counts=(((r"\b(?:in\s+order\s+to|due\s+to\s+the\s+fact\s+that|with\s+regard\s+to|with\s+respect\s+to|in\s+terms\s+of|at\s+this\s+point\s+in\s+time|it\s+is\s+important\s+to\s+note\s+that|it\s+should\s+be\s+noted\s+that|in\s+the\s+event\s+that)\b",), 1),)),
    Rule("Writing Depth", "Medium", "Nominalization density ({n} instances)", (), (), 0.75, "Prefer verb forms: 'use', 'operate', 'prioritize', 'implement'", counts=(((_NOMINAL,), 3),)),
    Rule("Writing Depth", "Medium", "Mixed verb tense for own contributions", (r"\bwe\s+(?:propose|present|introduce|design|develop)\b", r"\bwe\s+(?:proposed|presented|introduced|designed|developed)\b"), (), 0.70, "Normalize tense: present for claims about the paper, past for actions during the work"),
)

LEFTOVERS = (
    Rule("LLM Artifacts", "Medium", "ChatGPT-style template phrasing detected", (OnLow(
        r"as an AI (?:language model|assistant)|in conclusion, it is (?:important|worth noting|essential) to note|it is (?:important|crucial|essential) to (?:note|remember|emphasize) that|it is worth noting that|it (?:can|should) be (?:noted|observed|seen) that|"
        r"it may be (?:suggested|observed|noted) that|it (?:was|is) (?:observed|found|shown|concluded) that|it can be concluded that|delve(?:ing)? into|in the realm of|a tapestry of|(?:plays|play) a pivotal role|landscape of (?:the )?(?:research|modern)|"
        r"unleash(?:ing)? the (?:power|potential)|at the end of the day|it goes without saying|in today's (?:fast-?paced|digital|modern) world"),), (), 0.70, "Rewrite the flagged phrases in natural academic voice; disclose any AI writing assistance per venue policy"),
    Rule("LLM Artifacts", "High", "Hallucinated-reference signature", (r"references", r"doi\s*[:\s]*\s*(?:N/?A|none|TBD|xxx|\?)\b|et al\.?\s*\(\s*n\.?d\.?\)|n\.?d\.?\s*,?\s*(?:p\.?|pp\.?)\s*[0-9]+"), (), 0.75, "Verify every reference resolves to a real DOI; delete any that do not"),
    Rule("LLM Artifacts", "High", "Placeholder text left in manuscript", (r"placeholder|\[insert|TBD\b|XXX|Lorem ipsum",), (), 0.95, "Remove all placeholder text before submission"),
)

_STATED = r"\bp\s*[<>=]\s*0\.\d|\bt\s*\(\s*\d+|\bF\s*\(\s*\d+|\br\s*[=]\s*[-\d]|\bOR\s*[=]|\bCI\b|\bstatistically\b|\bsignificant\b|\beffect\s+size|\bregression\b|\bsample\s+size"
STATISTICS = (
    Rule("Statistics", "High", "p-value reported as 0.000", (_STATED, r"p\s*[=<>]\s*0\.000\b"), (), 0.98, "Replace 'p = 0.000' with 'p < .001'"),
    Rule("Statistics", "High", "No effect sizes reported", (_STATED, r"\bregression\b"), (r"cohen'?s?\s*d\s*[=<>]|\bOR\s*[=<>]\s*[\d.]|\bodds\s+ratio|R[_²]*squared|beta\b|eta|\bη",), 0.90, "Report effect sizes for every statistical test"),
    Rule("Statistics", "Critical", "Impossible correlation coefficient", (_STATED, OnText(r"\br\s*[=]\s*-?(?:1\.\d*[1-9]|[2-9]|\d{2})")), (), 0.99, "Verify r-value"),
    Rule("Statistics", "High", "Multiple comparisons without correction", (_STATED,), (r"bonferroni|fdr|holm|sidak|tukey|benjamini|hochberg",), 0.85, "Apply Bonferroni/FDR/Holm correction", counts=(((OnText(r"\bp\s*<\s*0?\.\d+"),), 3),)),
    Rule("Statistics", "Medium", "Regression without R-squared", (_STATED, r"\bregression\b"), (r"R[_\s²]*squared\s*[=]",), 0.80, "Report R-squared"),
)

COMPILATION = (
    Rule("Compilation", "High", "Broken LaTeX cross-references (?? in compiled text)", (OnText(r"\?\?|\[\?\]"),), (), 0.90, "Resolve the undefined references before submitting.", 150),
    Rule("Compilation", "High", "Broken Word cross-references in document text", (r"Error!\s+Reference\s+source\s+not\s+found|Error!\s+Bookmark\s+not\s+defined",), (), 0.95, "Update all fields and fix missing references, then re-export the PDF.", 150),
    Rule("Submission", "High", "Placeholder text left in the manuscript", (r"\b(?:TODO\s*[:.]?|lorem\s+ipsum|your[\s-]*(?:repo|username|link|url)[\s-]*(?:here)?|insert\s+(?:url|link|repo)|example\.com|www\.example\.(?:com|org)|<url>|<link>)",), (), 0.90, "Search the document for 'TODO' before submitting.", 150),
)

_LETTER = r"response\s+to\s+reviewers?|point-?by-?point|reviewer\s+[1-9]|comments?\s+of\s+the\s+reviewers?|rebuttal|we\s+(?:thank|appreciate)\s+the\s+reviewers?"
_NEW = r"new\s+(?:experiment|analysis|data|figure|table|results?|evaluation)|added\s+(?:an?\s+)?(?:experiment|analysis|section|figure|table)|additional\s+(?:experiment|analysis|evidence)|revised\s+(?:the\s+)?(?:manuscript|section|figure|table)|we\s+now\s+(?:show|report|include|provide)"
REBUTTAL = (
    Rule("Rebuttal", "Medium", "No reviewer sections identified", (_LETTER,), (r"\breviewer\s+([1-9])\b",), 0.85, "Organize the response by reviewer, then by comment number"),
    Rule("Rebuttal", "High", "No explicit responses found", (_LETTER, r"\breviewer\s+([1-9])\b"), (r"\bresponse\s*[:.]|we\s+(?:thank|agree|have\s+(?:revised|added|modified|clarified|included|updated|changed))|done\s*[:.]|fixed\s*[:.]",), 0.80, "Add an explicit response after every comment"),
    Rule("Rebuttal", "High", "Defensive tone toward reviewers", (_LETTER, r"\b(reviewer\s+(?:is\s+)?(?:wrong|incorrect|mistaken|misunderstands?|misread))|(?:we\s+)?disagree\s+strongly|that\s+is\s+not\s+true|the\s+reviewer\s+fails?"), (), 0.80, "Rephrase as 'We clarify that...' / 'We respectfully note that...' even when disagreeing"),
    Rule("Rebuttal", "Info", "New evidence present in response", (_LETTER, _NEW), (), 0.90, "Keep pointing each added item to its location in the revised manuscript (line/section)"),
    Rule("Rebuttal", "Medium", "Response shows little new evidence", (_LETTER,), (_NEW,), 0.70, "Add at least one new experiment/analysis per major criticism, or state clearly why it is infeasible"),
)

ENGINES = {
    "statistics": STATISTICS, "compilation_hygiene": COMPILATION, "rebuttal": REBUTTAL,
    "methodology": METHODOLOGY, "authorship": AUTHORSHIP, "funder_compliance": FUNDERS, "legal_ethics": LEGAL, "reproducibility": REPRODUCIBILITY, "domain_checklists": CHECKLISTS, "stats_deep": STATISTICS_DEEP,
    "engineering_vv": ENGINEERING, "venue_general": VENUE_GENERAL, "trial_ethics": TRIAL_ETHICS, "country_standards": COUNTRIES, "claims": CLAIMS, "asa_pvalues": ASA, "power_adequacy": POWER, "ml_fairness": FAIRNESS,
    "proof_gaps": PROOFS, "writing_depth": STYLE, "llm_artifacts": LEFTOVERS,
}
RULES = tuple(r for rules in ENGINES.values() for r in rules)
