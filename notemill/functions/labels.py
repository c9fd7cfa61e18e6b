"""Domain labels that notebooks are ranked by."""

from __future__ import annotations

# The labels of the special terms list.
DOMAINS = [
    "random forest", "tqdm", "sports", "movies and tv shows", "time series analysis", "healthcare", "plotly", "ml ethics", "dailychallenge", "wandb", "ensembling", "celebrities",
    "text mining", "jobs and career", "python", "advanced", "religion and belief systems", "adversarial learning", "eyes and vision", "image", "classification", "gradient boosting",
    "tensorflow", "data analytics", "weather and climate", "travel", "optimization", "insurance", "convolution", "transportation", "image augmentation", "spaCy", "image generator",
    "education", "randomForest", "regression", "india", "selective kernel", "bayesian statistics", "physics", "seaborn", "english", "gpu", "real estate", "video", "arts and entertainment",
    "exercise", "energy", "weight standardization", "logistic regression", "reinforcement learning", "tabular", "retail and shopping", "multiclass classification", "cv2", "finnish",
    "diseases", "sklearn", "dnn", "nltk", "games", "social science", "video games", "multimodal", "manufacturing", "neural networks", "finance", "data visualization", "image segmentation",
    "resnet v2 50", "gan", "xgboost", "categorical", "pytorch", "law", "keras", "computer vision", "transformers", "rnn", "tpu", "programming", "atmospheric science", "text",
    "currencies and foreign exchange", "scipy", "business", "matplotlib", "comics and animation", "utility script", "medicine", "software", "cnn", "cities and urban areas",
    "artificial intelligence", "environment", "text pre-processing", "audio", "covid19", "binary classification", "food", "multilabel classification", "feature engineering",
    "linear regression", "model comparison", "inception resnet v2", "art", "sampling", "nlp", "recommender systems", "biology", "text generation", "crime", "agriculture", "health", "news",
    "lightgbm", "psychology", "diabetes", "neuroscience", "data cleaning", "heart conditions", "automl", "animals", "PIL", "pandas", "deep learning", "torchvision", "tidyverse",
    "earth science", "baseball", "IPython", "exploratory data analysis", "beginner", "transfer learning", "model explainability", "cancer", "numpy", "music", "learn", "image classification",
    "lstm", "online communities", "intermediate", "decision tree",
]
