"""Paper classes, methods and software from recorded checklist facts, kept only where the text supports them.

The facts are input tables: what a reader or model answered, with a quote. The rules only compare answers with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import distinct_ignoring_case, quote_in_text, software_key, squeeze, tags

# Facts and the class or method they speak for.
LABEL_OF_FACT = {
    "develops_new_bayesian_model": "model_development", "develops_new_bayesian_method": "method_development", "develops_new_bayesian_software": "software_development", "uses_bayesian_model_on_real_data": "data_analysis",
    "runs_numerical_or_simulation_study": "numerical_analysis", "investigates_theoretical_behavior": "theoretical_analysis", "is_review_tutorial_or_commentary": "review",
}
METHOD_OF_FACT = {
    "uses_mcmc": "mcmc", "uses_variational_inference": "variational", "uses_sbi": "sbi", "uses_abc": "abc", "uses_smc_or_particle_filter": "smc", "uses_laplace_or_inla": "laplace_inla",
    "uses_map": "map", "uses_em": "em", "uses_exact_or_analytic_posterior": "exact_analytic",
}
# Which class leads, and which others may follow it, in order.
LEADING = ("method_development", "model_development", "software_development", "data_analysis", "numerical_analysis", "theoretical_analysis", "review")
FOLLOWING = {
    "method_development": ("model_development", "software_development", "numerical_analysis", "theoretical_analysis", "data_analysis"),
    "model_development": ("data_analysis", "numerical_analysis", "theoretical_analysis", "method_development", "software_development"),
    "software_development": ("method_development", "numerical_analysis", "data_analysis", "model_development", "theoretical_analysis"),
    "data_analysis": ("model_development", "method_development", "theoretical_analysis", "numerical_analysis", "software_development"),
    "numerical_analysis": ("method_development", "model_development", "software_development", "theoretical_analysis", "data_analysis"),
    "theoretical_analysis": ("method_development", "model_development", "numerical_analysis", "software_development", "data_analysis"),
    "review": (),
}
MOST_LABELS = 4
# Cues of a class in a quote.
LABEL_CUES = {
    "model_development": r"(?i)\b(new|novel|propos|introduc|develop|extend).{0,80}\b(model|prior|likelihood|latent)\b|\b(model|prior|likelihood|latent).{0,80}\b(new|novel|propos|introduc|develop|extend)\b",
    "method_development": r"(?i)\b(new|novel|propos|introduc|develop|extend).{0,80}\b(method|algorithm|sampler|prior|procedure|workflow|diagnostic|framework|inference)\b|\b(method|algorithm|sampler|prior|procedure|workflow|diagnostic|framework|inference).{0,80}\b(new|novel|propos|introduc|develop|extend)\b",
    "software_development": r"(?i)\b(software|package|library|toolbox|tool|implementation|bayesflow)\b",
    "data_analysis": r"(?i)\b(real|empirical|observed|experimental|field|survey|clinical)\b.{0,80}\b(data|dataset|application|case study)\b|\b(data|dataset).{0,80}\b(real|empirical|observed|experimental|field|clinical)\b",
    "numerical_analysis": r"(?i)\b(simulat\w*|simulation study|simulated data|synthetic|benchmark|numerical experiment|toy example|toy model)\b",
    "theoretical_analysis": r"(?i)\b(theorem|proposition|lemma|corollary|proof|derivation|derivations|posterior contraction|asymptotic|asymptotics|consistency|convergence rate)\b",
    "review": r"(?i)\b(review|survey|tutorial|perspective|commentary)\b",
}
# Cues of a method in a quote.
METHOD_CUES = {
    "mcmc": r"(?i)\b(mcmc|markov chain monte carlo|nuts|hamiltonian monte carlo|hmc|gibbs|metropolis|stan|pymc|bambi|brms|rstanarm|jags|bugs|turing|numpyro|blackjax|hddm|hssm)\b",
    "variational": r"(?i)\b(variational inference|variational bayes|advi|elbo|mean[- ]field)\b",
    "sbi": r"(?i)\b(sbi|simulation[- ]based inference|amortized bayesian|likelihood[- ]free inference|neural (posterior|likelihood|ratio|score)|normalizing flow|invertible neural network|bayesflow)\b|trained .{0,80}\bsimulat",
    "abc": r"(?i)\b(abc|abc[- ]smc|approximate bayesian computation|rejection abc|distance|tolerance)\b",
    "smc": r"(?i)\b(sequential monte carlo|particle filter|particle filtering|particle mcmc|smc)\b",
    "laplace_inla": r"(?i)\b(laplace approximation|inla)\b",
    "map": r"(?i)\b(maximum[- ]a[- ]posteriori|map estimat\w*|map estimates?|posterior mode)\b",
    "em": r"(?i)\b(expectation[- ]maximization|em algorithm|em-style)\b",
    "exact_analytic": r"(?i)\b(conjugate|closed[- ]form|analytic posterior|exact posterior|analytic updating)\b",
}
METHOD_DETECTOR = {"mcmc": "method.mcmc", "variational": "method.variational", "sbi": "method.sbi", "abc": "method.abc", "smc": "method.smc", "laplace_inla": "method.laplace_inla", "map": "method.map", "em": "method.em", "exact_analytic": "method.analytic"}
# Patterns about theory, priors, usage and simulation-based inference.
FORMAL = r"(?i)\b(theorem|proposition|lemma|corollary|proof)\b"
DERIVES = r"(?i)\b(derive[sd]?|deriving|derivation|derivations|asymptotic|asymptotics|asymptotically|establish(?:es|ed|ing)?|show(?:s|ed|ing)?)\b"
PROPERTY = r"(?i)\b(properties|posterior contraction|contraction rates?|posterior consistency|consistency|convergence rates?|asymptotic normality|asymptotic distribution|minimax rates?|identifiability|identification)\b"
GENERAL_PRIOR = r"(?i)\b(prior famil(?:y|ies)|elicitation|general[- ]purpose prior|default regularizing prior|regularizing prior|weakly[- ]informative prior|prior on model fit|bayesian coefficient of determination|coefficient of determination|r2|r\^2|beta prior|induced prior|global variance parameter|variance parameters?|posterior contraction)\b"
SPECIFIC_PRIOR = r"(?i)\bmodel[- ]specific prior\b|\bprior for (?:the )?(?:[a-z0-9-]+\s+){0,4}(?:model|models|likelihood|latent process)\b"
OWN_MODEL = r"(?i)\b(new|novel|propos\w*|introduc\w*|develop\w*|extend\w*)\b(?!.{0,60}\bprior\b).{0,100}\b(probabilistic model|generative model|hierarchical model|latent(?: stochastic)? process|simulator|likelihood|joint dependence structure)\b|\b(probabilistic model|generative model|hierarchical model|latent(?: stochastic)? process|simulator|likelihood|joint dependence structure)\b.{0,100}\b(new|novel|propos\w*|introduc\w*|develop\w*|extend\w*)\b"
PROCEDURE = r"(?i)\b(sampler|algorithm|variational|diagnostic|elicitation|workflow|validation|model[- ]checking|inference (?:method|procedure|scheme))\b"
USAGE = r"(?i)\b(?:we|our)\b(?:(?!\b(?:it|that|which|why|how|they)\b)[^.;]){0,60}\b(?:fit(?:ted|ting)?|ran|run(?:ning)?|sampl\w*|estimat\w*|train(?:ed|ing)?|appl(?:y|ied|ying)|us(?:e|ed|ing)|implement\w*|comput\w*|dr[ae]w\w*|obtain\w*|infer\w*|recover\w*|approximat\w*)\b|\b(?:was|were)\s+(?:fit(?:ted)?|run|sampled|estimated|trained|implemented|applied|performed|computed|obtained|drawn|inferred|carried out)\b|\bin (?:the\s+)?present (?:article|paper|work|study)\b|\bthis (?:paper|article|study|work)\b"
INVERTIBLE = r"(?i)\b(invertible neural networks?|inns?)\b"
POSTERIOR_OF = r"(?i)\bposterior (?:parameter )?distribution\b|\bparameter distribution\b|\bdistribution over parameter space\b|\bfull distribution over parameter space\b"
INVERSE = r"(?i)\binverse problems?\b|\binverse pass\b"
SIMULATOR = r"(?is)\b(train(?:ed|ing)?|learn(?:ed|ing)?)\b.{0,160}\b(simulat\w*|synthetic|forward model|forward process|simulator)\b|\b(simulat\w*|synthetic|forward model|forward process|simulator)\b.{0,160}\b(train(?:ed|ing)?|learn(?:ed|ing)?)\b"
NEURAL = r"(?i)\b(neural posterior|neural likelihood|neural ratio|neural score|normalizing flow|amortized bayesian|likelihood-free inference)\b"
# Names of software by key, languages that only qualify custom code, and tools that aren't for inference.
CANONICAL = {
    "bayesflow": "BayesFlow", "sbi": "sbi", "neuralestimators": "NeuralEstimators.jl", "neuralestimatorsjl": "NeuralEstimators.jl", "pyabc": "pyABC", "blackjax": "BlackJAX", "pyro": "Pyro", "pyroppl": "Pyro", "stan": "Stan", "pystan": "PyStan",
    "cmdstan": "CmdStan", "cmdstanr": "CmdStanR", "cmdstanpy": "CmdStanPy", "pymc": "PyMC", "pymc3": "PyMC", "pymc4": "PyMC", "bambi": "Bambi", "brms": "brms", "rstanarm": "rstanarm", "jags": "JAGS", "bugs": "BUGS", "openbugs": "OpenBUGS",
    "winbugs": "WinBUGS", "turing": "Turing.jl", "turingjl": "Turing.jl", "numpyro": "NumPyro", "tensorflowprobability": "TensorFlow Probability", "tfp": "TensorFlow Probability", "hddm": "HDDM", "hssm": "HSSM", "custom": "Custom",
    "customcode": "Custom", "customimplementation": "Custom", "custompython": "Custom (Python)", "customr": "Custom (R)", "customjulia": "Custom (Julia)", "custommatlab": "Custom (MATLAB)",
}
LANGUAGES = {"python": "Python", "r": "R", "rlanguage": "R", "julia": "Julia", "matlab": "MATLAB", "cpp": "C++", "cplusplus": "C++", "c": "C", "javascript": "JavaScript", "typescript": "TypeScript"}
OTHER_TOOLS = ("scikitlearn", "sklearn", "mcp", "pandas", "numpy", "matplotlib", "r", "rproject", "rlanguage", "rstudio", "python", "julia", "matlab", "octave", "c", "cpp", "cplusplus", "csharp", "java", "javascript", "typescript", "bash", "shell", "unix", "linux")
IMPLIED = {
    "sbi": ("bayesflow", "sbi", "neuralestimators", "neuralestimatorsjl"), "abc": ("pyabc",),
    "mcmc": ("stan", "pystan", "cmdstan", "cmdstanr", "cmdstanpy", "pymc", "pymc3", "pymc4", "bambi", "brms", "rstanarm", "jags", "bugs", "openbugs", "winbugs", "turing", "turingjl", "numpyro", "tensorflowprobability", "tfp", "hddm", "hssm", "blackjax"),
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _cue(name: Column, cues: dict[str, str], text: Column) -> Column:
    return F.coalesce(*[F.when(name == k, text.rlike(p)) for k, p in cues.items()], F.lit(False))


def surviving_labels(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Class facts that hold: yes, sure, and with a quote from the text or a cue; theory also needs a theorem or a derived property."""
    f = facts.withColumn("label", lookup(F.col("fact_name"), LABEL_OF_FACT)).filter("label IS NOT NULL").join(contexts, "doc")
    quote, text = F.coalesce("evidence", F.lit("")), F.concat(F.coalesce("evidence", F.lit("")), F.lit("\n"), F.col("context"))
    theory = text.rlike(FORMAL) | (text.rlike(DERIVES) & text.rlike(PROPERTY))
    ok = (F.col("answer") == "yes") & (F.col("confidence") == "high") & (quote_in_text(quote, F.col("context")) | _cue(F.col("label"), LABEL_CUES, quote)) & ((F.col("label") != "theoretical_analysis") | theory)
    return f.filter(ok)


def paper_labels(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc, labels: the leading class and those that may follow it, at most four; data_analysis where no fact holds.

    A general prior filed as a model is a method, and a prior for one model filed as a method is a model. A review stands alone.
    """
    s = surviving_labels(facts, contexts)
    of = lambda name: F.max(F.when(F.col("fact_name") == name, F.coalesce("evidence", F.lit(""))))
    quotes = facts.groupBy("doc").agg(of("develops_new_bayesian_model").alias("model_q"), of("develops_new_bayesian_method").alias("method_q"))
    c = contexts.join(s.groupBy("doc").agg(F.collect_set("label").alias("found")), "doc", "left").join(quotes, "doc", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    model_q, method_q = F.coalesce("model_q", F.lit("")), F.coalesce("method_q", F.lit(""))
    model, method = F.array_contains(found, "model_development"), F.array_contains(found, "method_development")
    where = F.when(method, F.concat(method_q, F.lit("\n"), model_q, F.lit("\n"), F.col("context"))).otherwise(model_q)
    to_method = model & where.rlike(GENERAL_PRIOR) & ~model_q.rlike(OWN_MODEL) & ~model_q.rlike(SPECIFIC_PRIOR)
    to_model = ~model & method & method_q.rlike(SPECIFIC_PRIOR) & ~method_q.rlike(GENERAL_PRIOR) & ~method_q.rlike(PROCEDURE)
    swapped = F.when(to_method, F.array_union(F.array_remove(found, "model_development"), F.array(F.lit("method_development")))).when(to_model, F.array_union(F.array_remove(found, "method_development"), F.array(F.lit("model_development")))).otherwise(found)
    c = c.select("doc", swapped.alias("f")).withColumn("f", F.when(F.size(F.array_remove("f", "review")) > 0, F.array_remove("f", "review")).otherwise(F.col("f")))
    lead = F.coalesce(*[F.when(F.array_contains("f", k), F.lit(k)) for k in LEADING])
    after = F.coalesce(*[F.when(F.col("lead") == k, F.array(*map(F.lit, v)).cast("array<string>")) for k, v in FOLLOWING.items()])
    c = c.withColumn("lead", lead)
    rest = F.filter(after, lambda x: F.array_contains("f", x))
    return c.select("doc", F.when(F.col("lead").isNull(), F.array(F.lit("data_analysis"))).otherwise(F.slice(F.concat(F.array("lead"), rest), 1, MOST_LABELS)).alias("labels"))


def _named(quote: Column, name: Column, canonical: Column) -> Column:
    """Whether the quote names the software, also without an ending like .jl, on borders of letters and digits."""
    low = F.lower(quote)
    base = lambda c: F.when(c.contains(".") & (F.length(F.substring_index(c, ".", 1)) > 2), F.substring_index(c, ".", 1))
    names = F.array_compact(F.array(F.lower(name), F.lower(canonical), base(F.lower(name)), base(F.lower(canonical))))
    quoted = lambda t: F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])"))
    return F.exists(F.filter(names, lambda t: t != ""), lambda t: F.rlike(low, quoted(t)))


def paper_software(software_facts: DataFrame, contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, software: canonical names of software whose use is quoted from the text; "Custom" where nothing is left, except for reviews and theory."""
    f = software_facts.join(contexts, "doc").withColumn("key", software_key(F.col("name")))
    f = f.withColumn("canonical", F.coalesce(lookup(F.col("key"), CANONICAL), F.col("name"))).withColumn("language", lookup(F.col("key"), LANGUAGES))
    grounded = F.col("language").isNull() & ~F.col("key").isin(*OTHER_TOOLS) & (F.col("confidence") == "high") & quote_in_text(F.col("evidence"), F.col("context")) & (F.col("key").startswith("custom") | _named(F.coalesce("evidence", F.lit("")), F.col("name"), F.col("canonical")))
    rows = f.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(grounded, F.struct("pos", "canonical")))).alias("s"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("pos"))).alias("language"))
    j = labels.join(rows, "doc", "left")
    names = distinct_ignoring_case(F.transform(F.coalesce("s", F.array().cast("array<struct<pos:int,canonical:string>>")), lambda x: x["canonical"]))
    qualified = F.transform(names, lambda x: F.when((software_key(x) == "custom") & F.col("language").isNotNull(), F.concat(F.lit("Custom ("), F.col("language"), F.lit(")"))).otherwise(x))
    thinking = F.size(F.array_except("labels", F.array(F.lit("review"), F.lit("theoretical_analysis")))) == 0
    return j.select("doc", F.when((F.size(names) == 0) & ~thinking, F.array(F.lit("Custom"))).otherwise(distinct_ignoring_case(qualified)).alias("software"))


def context_says_sbi(text: Column) -> Column:
    return (text.rlike(INVERTIBLE) & text.rlike(POSTERIOR_OF) & text.rlike(INVERSE)) | (text.rlike(NEURAL) & text.rlike(SIMULATOR))


def paper_methods(facts: DataFrame, contexts: DataFrame, evidence: DataFrame, software: DataFrame) -> DataFrame:
    """doc, methods: methods said to be used whose quote stands in the text and speaks of use, then those that the software implies.

    A method the software implies needs no more than its quote; others need the context, a detector hit or a cue.
    """
    keys = F.transform("software", software_key)
    implied = F.array_compact(F.array(*[F.when(F.arrays_overlap(keys, F.array(*map(F.lit, v))), F.lit(m)) for m, v in IMPLIED.items()]))
    soft = software.select("doc", implied.alias("implied"))
    f = facts.withColumn("method", lookup(F.col("fact_name"), METHOD_OF_FACT)).filter("method IS NOT NULL AND answer = 'yes'").join(contexts, "doc").join(soft, "doc", "left")
    f = f.withColumn("q", squeeze(F.coalesce("evidence", F.lit("")))).withColumn("detector", lookup(F.col("method"), METHOD_DETECTOR))
    e = evidence.select("doc", F.col("detector_id").alias("detector"), squeeze(F.col("quote")).alias("h"))
    hits = f.filter("q <> ''").select("doc", "method", "q", "detector").join(e, ["doc", "detector"]).filter(F.contains("h", "q") | F.contains("q", "h")).select("doc", "method").distinct().withColumn("hit", F.lit(True))
    f = f.join(hits, ["doc", "method"], "left")
    by_software = F.coalesce(F.array_contains("implied", F.col("method")), F.lit(False))
    supported = F.coalesce("hit", F.lit(False)) | ((F.col("method") == "sbi") & context_says_sbi(F.col("context"))) | _cue(F.col("method"), METHOD_CUES, F.col("q"))
    ok = quote_in_text(F.col("evidence"), F.col("context")) & (by_software | (F.col("q").rlike(USAGE) & supported))
    place = F.coalesce(*[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(METHOD_OF_FACT.values())])
    said = f.filter(ok).groupBy("doc").agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("i"), "method"))), lambda x: x["method"]).alias("said"))
    none = F.array().cast("array<string>")
    return contexts.select("doc").join(said, "doc", "left").join(soft, "doc", "left").select("doc", F.array_distinct(F.concat(F.coalesce("said", none), F.coalesce("implied", none))).alias("methods"))


def fact_confidence(facts: DataFrame) -> DataFrame:
    """doc, confidence: the mean of 0.9 for sure and 0.65 for other yes-facts, to two places; 0.5 without any."""
    v = F.when(F.col("answer") == "yes", F.when(F.col("confidence") == "high", 0.9).otherwise(0.65))
    return facts.groupBy("doc").agg(F.coalesce(F.bround(F.avg(v), 2), F.lit(0.5)).alias("confidence"))


def disciplines(column: Column) -> Column:
    """At most three discipline tags; statistics where there is none."""
    t = tags(column, 3, underscores=True)
    return F.when(F.coalesce(F.size(t), F.lit(0)) > 0, t).otherwise(F.array(F.lit("statistics")))


def expectation_tiers(labels: DataFrame, steps: DataFrame, tiers: DataFrame) -> DataFrame:
    """doc, step_id, tier: the strongest expectation over a document's labels (expected, recommended, none) and the labels that ask for it.

    ``labels``: doc, label; ``steps``: step_id; ``tiers``: step_id, label, tier. The rubric's tables are small and fixed.
    """
    rank = F.when(F.col("tier") == "expected", 2).when(F.col("tier") == "recommended", 1).otherwise(0)
    known = tiers.withColumn("rank", rank).groupBy("step_id", "label").agg(F.max("rank").alias("rank"))
    docs = labels.groupBy("doc").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    # one row holds the rubric's steps, joined to the distinct label sets by a constant
    listed = steps.agg(F.array_sort(F.collect_set("step_id")).alias("ids")).withColumn("_one", F.lit(1))
    sets = docs.select("labels").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").select("labels", F.explode("ids").alias("step_id")).withColumn("label", F.explode("labels"))
    joined = sets.join(F.broadcast(known), ["step_id", "label"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    best = joined.withColumn("top", F.max("rank").over(Window.partitionBy("labels", "step_id"))).filter("rank = top")
    tier = best.groupBy("labels", "step_id").agg(F.max("top").alias("top"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("asked_by"))
    name = F.when(F.col("top") == 2, "expected").when(F.col("top") == 1, "recommended").otherwise("none")
    return docs.join(tier, "labels").select("doc", "step_id", name.alias("tier"), "asked_by")
