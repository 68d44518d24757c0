"""The pipelines and policies that come with the engine. Fixed values, as configuration text."""

from __future__ import annotations

import yaml

from guardspark.sources.config import Policy

# Six pipelines.
PIPELINES_YAML = """
basic-safety:
  stages:
    - {type: parallel, name: safety-check, classifiers: [toxicity, sentiment, pii], aggregation: max_score}
advanced-safety:
  stages:
    - {type: single, name: initial-toxicity, classifier: toxicity-distilled}
    - {type: conditional, name: deep-toxicity-check, classifier: toxicity, condition: {any_above_threshold: {threshold: 0.5}}}
    - {type: parallel, name: compliance-checks, classifiers: [prompt-injection, financial-advice], aggregation: max_score}
content-quality:
  stages:
    - {type: sequential, name: quality-analysis, classifiers: [sentiment, readability]}
comprehensive-safety:
  stages:
    - {type: parallel, name: all-safety-checks, classifiers: [toxicity, sentiment, prompt-injection, pii], aggregation: unanimous}
fast-triage:
  stages:
    - {type: parallel, name: quick-checks, classifiers: [toxicity-distilled, prompt-injection, pii], aggregation: {first_positive: {threshold: 0.7}}}
weighted-analysis:
  stages:
    - {type: parallel, name: multi-signal, classifiers: [toxicity, sentiment, readability], aggregation: weighted_average}
"""

# The default policy.
DEFAULT_YAML = r"""
name: default-safety-policy
version: "1.0"
rules:
  - name: pii-detection
    trigger: {type: classifier, classifier: pii_detector, threshold: 0.9}
    actions:
      - {type: redact, replacement: "[REDACTED]"}
      - {type: audit, category: pii_exposure, severity: high}
  - name: toxicity-filter
    trigger: {type: classifier, classifier: toxicity, threshold: 0.8}
    actions:
      - {type: stop, message: Content blocked due to policy violation, status_code: 451}
      - {type: audit, category: toxicity, severity: high}
  - name: prompt-injection-defense
    trigger: {type: pattern, pattern: "(ignore|disregard|forget).*(previous|above|instruction)", case_insensitive: true}
    actions:
      - {type: log, message: Potential prompt injection detected, level: warn}
      - {type: stop, message: Request cannot be processed}
  - name: sensitive-patterns
    trigger:
      type: composite
      operator: or
      triggers:
        - {type: pattern, pattern: '\b\d{3}-\d{2}-\d{4}\b'}
        - {type: pattern, pattern: '\b\d{16}\b'}
    actions:
      - {type: redact}
      - {type: audit, category: sensitive_data, severity: critical}
"""

# The consumer-duty policy.
CONSUMER_DUTY_YAML = r"""
name: fca-consumer-duty
version: "1.0"
regulation: "FCA Consumer Duty (PRIN 2A)"
rules:
  - name: investment-advice-detection
    regulation: "FCA COBS 9A.2.1"
    trigger: {type: classifier, classifier: advice_vs_information, threshold: 0.75}
    actions:
      - {type: inject, position: after, content: "\n\n**Important**: This is general information only, not personalized financial advice. Consider your individual circumstances and speak to a qualified advisor."}
      - {type: audit, category: advice_boundary, severity: high}
  - name: prevent-unsuitable-recommendations
    regulation: "FCA PRIN 2A.4.1"
    trigger: {type: classifier, classifier: suitability_risk, threshold: 0.8}
    actions:
      - {type: stop, status_code: 451, message: "I cannot provide personalized investment recommendations without understanding your financial situation, objectives, and risk tolerance. Please speak with a financial advisor for personalized guidance."}
      - {type: audit, category: suitability_prevented, severity: critical}
  - name: vulnerability-detection
    regulation: "FCA FG21/1 (Guidance for firms on the fair treatment of vulnerable customers)"
    trigger: {type: pattern, pattern: "(can't pay|struggling|bereaved|disabled|anxious|depressed|confused|lost job|redundant)", case_insensitive: true}
    actions:
      - {type: inject, position: after, content: "\n\nIf you're facing financial difficulties, we're here to help. You can access support at [support resources] or contact our specialist team."}
      - {type: audit, category: vulnerability_detected, severity: medium}
  - name: fee-transparency
    regulation: "FCA PRIN 2A.3.1"
    trigger: {type: pattern, pattern: "(fee|charge|cost|price|commission)", case_insensitive: true}
    actions:
      - {type: log, message: Fee-related content detected - ensure transparency, level: info}
      - {type: audit, category: fee_disclosure, severity: low}
  - name: prevent-misleading-claims
    regulation: "FCA PRIN 2A.5.4"
    trigger:
      type: composite
      operator: or
      triggers:
        - {type: pattern, pattern: "(guaranteed return|risk-free|can't lose|always profitable)", case_insensitive: true}
        - {type: classifier, classifier: promotional_claim, threshold: 0.85}
    actions:
      - {type: redact, replacement: "[claim removed for regulatory compliance]"}
      - {type: inject, position: after, content: "\n\n**Risk Warning**: The value of investments can go down as well as up, and you may get back less than you invested."}
      - {type: audit, category: misleading_claim_prevented, severity: critical}
  - name: ensure-risk-warnings
    regulation: "FCA COBS 4.5.2"
    trigger:
      type: composite
      operator: and
      triggers:
        - {type: pattern, pattern: "(invest|portfolio|stocks|shares|bonds|crypto|trading)", case_insensitive: true}
        - {type: context, field: response_length, value: ">200"}
    actions:
      - {type: inject, position: after, content: "\n\n**Risk Warning**: Investments carry risk. The value can fall as well as rise and you may not get back the amount invested. Past performance is not a reliable indicator of future results."}
      - {type: audit, category: risk_warning_injected, severity: medium}
  - name: product-information-completeness
    regulation: "FCA PRIN 2A.2.3"
    trigger: {type: pattern, pattern: "(ISA|pension|SIPP|bond|fund|ETF|structured product)", case_insensitive: true}
    actions:
      - {type: log, message: Product mention detected - ensure complete disclosure, level: warn}
      - {type: inject, position: after, content: "\n\nFor full product details, charges, and risks, please refer to the Key Information Document (KID) and product documentation."}
      - {type: audit, category: product_disclosure, severity: medium}
  - name: complexity-check
    regulation: "FCA Consumer Duty Outcome: Consumer Understanding"
    trigger: {type: classifier, classifier: readability_score, threshold: 0.7}
    actions:
      - {type: log, message: Complex language detected - consider simplification, level: warn}
      - {type: audit, category: complexity_flagged, severity: low}
  - name: foreseeable-harm-prevention
    regulation: "FCA PRIN 2A.1.13 (Foreseeable Harm)"
    trigger:
      type: composite
      operator: or
      triggers:
        - {type: pattern, pattern: "(borrow to invest|take loan for trading|max out credit card)", case_insensitive: true}
        - {type: classifier, classifier: harmful_strategy, threshold: 0.8}
    actions:
      - {type: stop, status_code: 451, message: "I cannot provide guidance that may lead to financial harm. Please consult a qualified financial advisor."}
      - {type: audit, category: harm_prevented, severity: critical}
  - name: pii-redaction
    regulation: "GDPR Article 5(1)(f) / DPA 2018"
    trigger: {type: classifier, classifier: pii_detector, threshold: 0.9}
    actions:
      - {type: redact, replacement: "[REDACTED]"}
      - {type: audit, category: pii_exposure_prevented, severity: high}
"""

PIPELINES: dict[str, dict] = yaml.safe_load(PIPELINES_YAML)
DEFAULT = Policy.from_yaml(DEFAULT_YAML)
CONSUMER_DUTY = Policy.from_yaml(CONSUMER_DUTY_YAML)
