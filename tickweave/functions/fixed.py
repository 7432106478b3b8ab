"""These constants must equal the published ones for right results."""

#: Ten-component normal approximation of the log of a chi-square variable with one degree of freedom: weights, means, variances.
MIXTURE_WEIGHTS = (0.00609, 0.04775, 0.13057, 0.20674, 0.22715, 0.18842, 0.12047, 0.05591, 0.01575, 0.00115)
MIXTURE_MEANS = (1.92677, 1.34744, 0.73504, 0.02266, -0.85173, -1.97278, -3.46788, -5.55246, -8.68384, -14.65000)
MIXTURE_VARIANCES = (0.11265, 0.17788, 0.26768, 0.40611, 0.62699, 0.98583, 1.57469, 2.54498, 4.16591, 7.33342)
#: Mean (negated) and variance of that variable.
LOG_CHI_MEAN, LOG_CHI_VARIANCE = 1.27, 4.93
